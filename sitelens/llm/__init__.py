"""Operators for preparing language-model training data.

One module per operator, each a plain ``DataFrame -> DataFrame`` function with its
own parameters; ``queries.py`` holds the registered ``opN_*`` queries and their SQL.
Nothing else in the library imports this package.
"""
