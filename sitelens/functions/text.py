"""Text column expressions: entity decoding, tag stripping, whitespace trimming.

All are built from JVM built-ins so they stay inside whole-stage codegen.
"""

from __future__ import annotations

import json
from html.entities import html5, name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# Named character references come from the standard library's HTML5 table; the
# names that HTML also accepts without a semicolon, longest first. A map is searched
# from its start, so HTML 4's names, which most pages use, stand before the others.
NAMED = {k: html5[k + ";"] for k in name2codepoint} | {k[:-1]: v for k, v in html5.items() if k.endswith(";")}
BARE = sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k))
COMMON = ["amp", "lt", "gt", "quot", "nbsp", "copy"]  # tried before the table

# FIXED VALUES: numeric references 0x80–0x9F name windows-1252 characters in
# HTML (the standard remap); the five codes windows-1252 leaves undefined stay
# as the raw code point.
CP1252_REMAP = {
    0x80: "€", 0x82: "‚", 0x83: "ƒ", 0x84: "„", 0x85: "…", 0x86: "†", 0x87: "‡", 0x88: "ˆ",
    0x89: "‰", 0x8A: "Š", 0x8B: "‹", 0x8C: "Œ", 0x8E: "Ž", 0x91: "‘", 0x92: "’", 0x93: "“",
    0x94: "”", 0x95: "•", 0x96: "–", 0x97: "—", 0x98: "˜", 0x99: "™", 0x9A: "š", 0x9B: "›",
    0x9C: "œ", 0x9E: "ž", 0x9F: "Ÿ",
}

# Characters str.strip() removes (Unicode whitespace), as a regex class valid
# for both Java regex and RE2.
WS_CLASS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _utf8_char(cp: Column) -> Column:
    """The character for a Unicode code point, built from its UTF-8 bytes."""
    def byte(x: Column) -> Column:
        return F.lpad(F.hex(x), 2, "0")

    def cont(shift: int) -> Column:
        return byte(F.shiftright(cp, shift).bitwiseAND(0x3F).bitwiseOR(0x80))

    hexs = (
        F.when(cp < 0x80, byte(cp))
        .when(cp < 0x800, F.concat(byte(F.shiftright(cp, 6).bitwiseOR(0xC0)), cont(0)))
        .when(cp < 0x10000, F.concat(byte(F.shiftright(cp, 12).bitwiseOR(0xE0)), cont(6), cont(0)))
        .otherwise(F.concat(byte(F.shiftright(cp, 18).bitwiseOR(0xF0)), cont(12), cont(6), cont(0)))
    )
    return F.decode(F.unhex(hexs), "UTF-8")


def _numeric(cp: Column) -> Column:
    """The character of a numeric reference: windows-1252 names, '' for code points that
    HTML forbids, the replacement character for what is no character."""
    remap = F.element_at(F.create_map(*[x for k, v in CP1252_REMAP.items() for x in (F.lit(k), F.lit(v))]), cp.cast("int"))
    forbidden = (
        cp.between(1, 8) | (cp == 11) | cp.between(14, 31) | (cp == 127) | cp.between(0xFDD0, 0xFDEF)
        | (cp.bitwiseAND(F.lit(0xFFFE).cast("long")) == 0xFFFE)
    )
    nothing = (cp == 0) | cp.between(0xD800, 0xDFFF) | (cp > 0x10FFFF)
    return F.when(nothing, F.lit("\ufffd")).otherwise(
        F.coalesce(F.when(cp.between(0x80, 0x9F), remap), F.when(forbidden, F.lit("")).otherwise(_utf8_char(cp)))
    )


def _after_ampersand(p: Column) -> Column:
    """Decode the reference, if any, at the start of a piece that followed an ampersand."""
    number_re = r"^#(?:0*([0-9]+)|[xX]0*([0-9a-fA-F]+));?"

    def numbered(whole: Column) -> Column:
        # each is bound once: the character's byte form alone asks for the code point some twenty times
        digits = F.struct(F.regexp_extract(whole, number_re, 1).alias("dec"), F.regexp_extract(whole, number_re, 2).alias("hex"))
        cp = let(digits, lambda d: F.when(F.length(d["dec"]) + F.length(d["hex"]) > 7, F.lit(0x110000).cast("long")).otherwise(
            F.when(d["hex"] != "", F.conv(d["hex"], 16, 10)).otherwise(F.nullif(d["dec"], F.lit(""))).cast("long")
        ))
        return F.when(whole != "", F.concat(let(cp, _numeric), F.substring(p, F.length(whole) + 1, F.length(p)))).otherwise(F.concat(F.lit("&"), p))

    table = F.from_json(F.lit(json.dumps(NAMED)), "map<string,string>")  # folded to one literal
    bare = F.from_json(F.lit(json.dumps({k: html5[k] for k in BARE})), "map<string,string>")
    name = F.regexp_extract(p, r"^([a-zA-Z][a-zA-Z0-9]{0,31});", 1)
    start = F.regexp_extract(p, "^(?:" + "|".join(BARE) + ")", 0)
    # without a name nothing is looked up: a map is searched to its end for what it lacks
    closed = let(name, lambda n: F.when(n != "", F.concat(F.try_element_at(table, n), F.substring(p, F.length(n) + 2, F.length(p)))))
    open_ = let(start, lambda s: F.when(s != "", F.concat(F.try_element_at(bare, s), F.substring(p, F.length(s) + 1, F.length(p)))))
    out = F.when(p.startswith("#"), let(F.regexp_extract(p, r"^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", 0), numbered))
    for k in COMMON:
        out = out.when(p.startswith(k + ";"), F.concat(F.lit(html5[k + ";"]), F.substring(p, len(k) + 2, F.length(p))))
    return out.otherwise(F.coalesce(closed, open_, F.concat(F.lit("&"), p)))


def decode_entities(c: Column) -> Column:
    """``html.unescape``: every reference once, left to right. A text is cut at its
    ampersands, and each piece is decoded at its start only, so what a reference
    yields is never read again. Strings without '&' skip it all."""

    def joined(pieces: Column) -> Column:
        rest = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), _after_ampersand)
        return F.concat(F.element_at(pieces, 1), F.array_join(rest, ""))

    return F.when(F.instr(c, "&") > 0, let(F.split(c, "&", -1), joined)).otherwise(c)


def let(c: Column, body) -> Column:
    """Evaluate ``c`` once and use it any number of times in ``body``: a lambda variable
    is bound once, whereas an expression that holds higher-order functions is
    evaluated again at each of its uses."""
    return F.element_at(F.transform(F.array(c), body), 1)


def strip_ws(c: Column) -> Column:
    """Unicode-aware trim (Spark's trim only removes the space character)."""
    return F.regexp_replace(c, rf"^{WS_CLASS}+|{WS_CLASS}+$", "")


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^>]*>", "")


def node_text(inner: Column) -> Column:
    """``get_text().strip()`` of an element given its inner markup."""
    return strip_ws(let(strip_tags(inner), decode_entities))
