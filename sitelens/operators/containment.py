"""Which element holds what: nested intervals over a page's tags.

The tags of a page are numbered in document order. A stack pass gives every start tag the number of the tag
that closes it: its own end tag, or the end tag of an element around it, or the end of the page. An element's text is
then the slice of text runs between the two numbers.

Such a pass needs a stack that lives from tag to tag, which column expressions can only copy at each step (the square of
the tags). It is therefore one Arrow-batched UDF: markup goes to it, and the elements asked for come back with the text of their
attributes and what they hold, as it stands in the markup. Work is linear in the tags, and text costs what it is long.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from sitelens.operators.elements import TAG_RE

# FIXED VALUES: elements of HTML that have no end tag.
VOID = frozenset("area base basefont bgsound br col command embed frame hr image img input isindex keygen link menuitem meta nextid param source spacer track wbr".split())
FIELDS = frozenset(("input", "select", "textarea"))
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_HEADINGS = frozenset(HEADINGS)


def intervals(tags: list[str]) -> tuple[list[int], list[int], list[int], list[list[int]]]:
    """(close, upto, forms, fields) of a page's tags: ``x``, ``/x`` or, for one that ends itself, ``x/``.

    close: number of the tag that closes each start tag (the tag count at the end of the page), -1 for end tags.
    upto: where its text ends. That is ``close`` for an element with an end tag of its own; one without ends at
    the latest where the next of its kind (for headings: any heading) starts, so that unclosed tags share no text.
    forms, fields: numbers of the forms, and of the fields whose innermost open form each is."""
    n = len(tags)
    close, own = [-1] * n, [False] * n
    stack: list[int] = []
    open_: dict[str, int] = {}
    names: list[str] = []
    forms: list[int] = []
    fields: list[list[int]] = []
    around: list[int] = []  # open forms, as places in ``forms``
    kinds: list[str] = [""] * n
    for i, tag in enumerate(tags):
        if tag[0] == "/":
            name = tag[1:]
            if not open_.get(name):
                continue  # closes nothing
            while True:
                top, top_name = stack.pop(), names.pop()
                open_[top_name] -= 1
                close[top] = i
                if top_name == "form":
                    around.pop()
                if top_name == name:
                    own[top] = True
                    break
            continue
        ends = tag[-1] == "/"
        name = tag[:-1] if ends else tag
        kinds[i] = "h" if name in _HEADINGS else name
        if name == "form":
            around.append(len(forms))
            forms.append(i)
            fields.append([])
        elif name in FIELDS and around:
            fields[around[-1]].append(i)
        if ends or name in VOID:
            close[i], own[i] = i, True
            if name == "form":
                around.pop()
        else:
            stack.append(i)
            names.append(name)
            open_[name] = open_.get(name, 0) + 1
    for i in stack:
        close[i] = n
    upto, following = list(close), {}
    for i in range(n - 1, -1, -1):
        kind = kinds[i]
        if kind:
            if not own[i]:
                upto[i] = min(close[i], following.get(kind, n))
            following[kind] = i
    return close, upto, forms, fields


# \s and the classes of Java are ASCII
_TAG = re.compile(TAG_RE, re.ASCII)

#: What ``contained`` finds by kind, each element in document order: its name, the text of its attributes, the text it holds.
KINDS = {
    "links": "array<struct<tag:string,attrs:string,text:string>>",
    "heads": "array<struct<tag:string,text:string>>",
    "forms": "array<struct<attrs:string,fields:array<struct<tag:string,attrs:string>>>>",
}


class _Found:
    """Elements of many pages, column by column."""

    def __init__(self, *columns: str):
        self.sizes: list[int] = [0]
        self.columns: dict[str, list] = {c: [] for c in columns}

    def add(self, *columns: list) -> None:
        self.sizes.append(len(columns[0]))
        for into, values in zip(self.columns.values(), columns):
            into.extend(values)

    def array(self, **more: pa.Array) -> pa.Array:
        values = {c: pa.array(v, pa.string()) for c, v in self.columns.items()} | more
        return pa.ListArray.from_arrays(pa.array(accumulate(self.sizes), pa.int32()), pa.StructArray.from_arrays(list(values.values()), list(values)))


def found(pages: Iterable[str], kinds: tuple) -> pa.Array:
    """The elements of each page, by kind."""
    links, heads, forms, inputs = _Found("tag", "attrs", "text"), _Found("tag", "text"), _Found("attrs"), _Found("tag", "attrs")
    for markup in pages:
        cut = _TAG.split(markup)  # text, then name, attributes and text of each tag
        runs, tags, attrs = cut[::3], [t.lower() for t in cut[1::3]], cut[2::3]
        _, upto, at, held = intervals([t + "/" if a[-1:] == "/" and t[0] != "/" else t for t, a in zip(tags, attrs)])
        if "links" in kinds:
            i = [k for k, t in enumerate(tags) if t == "a" or t == "link"]
            links.add([tags[k] for k in i], [attrs[k] for k in i], ["".join(runs[k + 1 : upto[k] + 1]) if tags[k] == "a" else "" for k in i])
        if "heads" in kinds:
            i = [k for k, t in enumerate(tags) if t in _HEADINGS]
            heads.add([tags[k] for k in i], ["".join(runs[k + 1 : upto[k] + 1]) for k in i])
        if "forms" in kinds:
            forms.add([attrs[k] for k in at])
            for fields in held:
                inputs.add([tags[k] for k in fields], [attrs[k] for k in fields])
    arrays = {"links": links.array, "heads": heads.array, "forms": lambda: forms.array(fields=inputs.array())}
    return pa.StructArray.from_arrays([arrays[k]() for k in kinds], list(kinds))


@cache
def _reader(kinds: tuple):
    def read(markup: pa.Array) -> pa.Array:
        return found((page.as_py() for page in markup), kinds)  # one page's text at once

    return arrow_udf(read, "struct<" + ",".join(f"{k}:{KINDS[k]}" for k in kinds) + ">")


def contained(df: DataFrame, masked: str, *kinds: str) -> DataFrame:
    """``df`` with ``_in``: the elements of these ``KINDS`` in the markup of column ``masked``."""
    return df.withColumn("_in", _reader(kinds)(F.coalesce(F.col(masked), F.lit(""))))
