"""Tables of patterns (name, regular expression) matched against a text.

The literals that a pattern cannot do without are looked for first, all in one lower-cased copy of the text; the expression
itself runs only where one of them is found. A text without any of them costs substring searches alone.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST = 3  # characters of a literal worth looking for


def _alternatives(pattern: str) -> list[str] | None:
    """The pattern cut at its outer bars; None if it holds groups or classes."""
    plain = re.sub(r"\\.", "", pattern)
    return None if re.search(r"[()\[\]^$]", plain) else re.split(r"(?<!\\)\|", pattern)


def _literal(alternative: str) -> str:
    """The longest run of characters that every match of an alternative holds, in lower case."""
    runs, now, i = [], "", 0
    while i < len(alternative):
        c = alternative[i]
        if c == "\\" and i + 1 < len(alternative):
            c, i = alternative[i + 1], i + 1
            literal = not c.isalnum()  # \. is a dot, \d a class
        else:
            literal = c not in ".*+?{}"
        ahead = alternative[i + 1 : i + 2]
        if c in "{" and not literal:  # a counted repeat
            i = alternative.find("}", i)
            i = len(alternative) if i < 0 else i
        if literal and ahead not in ("*", "?", "{"):
            now += c
        else:
            runs.append(now)
            now = ""
        i += 1
    return max([*runs, now], key=len).lower()


def literals_of(pattern: str) -> list[str] | None:
    """One literal an alternative, of which every match holds one; None if some match may hold none."""
    cut = _alternatives(pattern)
    found = [_literal(a) for a in cut] if cut else []
    return found if found and all(len(x) >= LEAST and x.isascii() for x in found) else None


def matched(text: Column, low: Column, pattern: str) -> Column:
    """Does ``text`` match the pattern, in any case? ``low`` is the text in lower case."""
    hit = F.coalesce(text.rlike(f"(?i){pattern}"), F.lit(False))
    known = literals_of(pattern)
    if known is None:
        return hit
    return F.coalesce(holds_any(low, known), F.lit(False)) & hit


def holds_any(low: Column, literals: list[str]) -> Column:
    """Does the text hold one of these? A regular expression that is one literal is searched for by leaps (Boyer and Moore), which
    a substring test is not."""
    found = [low.rlike(re.sub(r"([^a-z0-9])", r"\\\1", x)) for x in literals]
    out = found[0]
    for x in found[1:]:
        out = out | x
    return out


def names_matched(text: Column, low: Column, patterns: list[tuple[str, str]]) -> list[Column]:
    """For each pattern its name where the text matches it, else null."""
    return [F.when(matched(text, low, p), F.lit(name)) for name, p in patterns]
