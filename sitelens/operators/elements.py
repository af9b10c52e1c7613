"""Per-page element arrays: the Spark stand-in for a DOM ``find_all``.

For every page row we derive, with JVM regex built-ins only,

* ``masked``  – the HTML with comments and script/style bodies blanked, so
  markup inside them is not mistaken for elements;
* ``el``      – ``array<struct<seq, tag, attrs, text>>``: one entry per start or
  end tag (end tags as ``/name``) in document order, its attributes
  (lower-cased names, entity-decoded values, last duplicate wins on lookup) and
  the raw text that follows it up to the next tag.

Everything stays inside the page's own row, so building and querying elements
is map-only: no shuffle, no per-page grouping, and a page's work is bounded by
its own size. Extractors ``filter``/``transform`` the array and ``explode`` only
their final facts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelens.functions.text import decode_entities, let, node_text

# Attribute text of a tag: quote-aware (a quoted '>' does not end the tag), then a
# plain fallback for a stray quote. A possessive group is matched in a loop, not by
# one recursion per value, so a tag may hold any number of attributes. The
# alternatives are disjoint by first character, so the possessive form matches
# exactly what the RE2 form (used by the SQL oracle) does.
_Q = r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+[^>]*+"""
_Q_RE2 = r"""[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*[^>]*"""


def _mask_re(q: str) -> str:
    # what is never closed reaches to the end of the page (and is read once)
    return rf"<!--.*?(?:-->|\z)|(<script\b{q}>).*?(</script\s*>|\z)|(<style\b{q}>).*?(</style\s*>|\z)"


# one look at a character, instead of one for each alternative
MASK_RE = rf"(?is)(?=<[!s])(?:{_mask_re(_Q)})"
MASK_RE2 = rf"(?is){_mask_re(_Q_RE2)}"
TAG_RE = rf"""<(/?[a-zA-Z][^\s/>]*)({_Q})>"""
TAG_RE2 = rf"""<(/?[a-zA-Z][^\s/>]*)({_Q_RE2})>"""
# Attribute name and its (possibly quoted) value as one group.
ATTR_RE = r"""([^\s"'=<>/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?"""
# The same as an atom without groups: what it matches first it never gives back. Java runs over a class of plain characters
# fastest, so ``\s`` is spelled out and the runs are greedy, not possessive.
_WS = r" \t\n\x0B\f\r"
_ATTR = rf"""(?>[^{_WS}"'=<>/]+(?:[{_WS}]*=[{_WS}]*(?:"[^"]*"|'[^']*'|[^{_WS}>]*))?)"""
STYLE_BLANK_RE = rf"(?is)(<style\b{_Q}>).*?(</style\s*>|\z)"
SCRIPT_BLANK_RE = rf"(?is)(<script\b{_Q}>).*?(</script\s*>|\z)"


def mask_html(html: Column) -> Column:
    return F.regexp_replace(html, MASK_RE, "$1$2$3$4")


def tag_attrs(attr_text: Column, only: tuple = ()) -> Column:
    """Attributes of a tag; with ``only``, those of these (lower-case ASCII) names."""

    def unquote(v: Column) -> Column:
        quoted = (F.length(v) >= 2) & (
            (v.startswith('"') & v.endswith('"')) | (v.startswith("'") & v.endswith("'"))
        )
        return F.when(quoted, F.substring(v, 2, F.length(v) - 2)).otherwise(v)

    if only:
        # a tag may hold many attributes that nobody asks for: the match runs over them and yields the others. \G ties it to the
        # end of the one before, so nothing inside a quoted value is taken for a name
        between = rf"""[{_WS}"'=<>/]*+"""
        wanted = rf"""(?i:{'|'.join(only)})(?![^{_WS}"'=<>/])"""
        pattern = rf"\G(?:{between}(?!{wanted}){_ATTR})*+{between}({_ATTR})"
        # a name holds no equals sign, so the first one ends it
        space = F.lit(" \t\n\x0b\f\r")

        def value(a: Column) -> Column:
            return let(F.ltrim(F.substring(a, F.instr(a, "=") + 1, F.length(a)), space), lambda v: decode_entities(unquote(v)))

        return F.transform(
            F.regexp_extract_all(attr_text, F.lit(pattern), 1),
            lambda a: F.struct(
                F.lower(F.rtrim(F.substring_index(a, "=", 1), space)).alias("k"),
                F.when(a.contains("="), value(a)).otherwise(F.lit("")).alias("v"),
            ),
        )
    names = F.regexp_extract_all(attr_text, F.lit(ATTR_RE), 1)
    vals = F.regexp_extract_all(attr_text, F.lit(ATTR_RE), 2)
    return F.transform(
        F.arrays_zip(names.alias("n"), vals.alias("v")),
        lambda a: F.struct(F.lower(a["n"]).alias("k"), decode_entities(unquote(a["v"])).alias("v")),
    )


def element_array(html: Column) -> Column:
    masked = mask_html(html)
    raw = F.regexp_extract_all(masked, F.lit(TAG_RE), 0)
    # Text after tag k is split piece k+1. Zip first so that the per-tag lambda
    # never refers to a whole-page expression (which would re-run per tag).
    texts = F.split(masked, TAG_RE)
    tail = F.slice(texts, 2, F.greatest(F.size(raw), F.lit(0)))
    zipped = F.arrays_zip(raw.alias("r"), tail.alias("t"))
    empty = F.array().cast("array<struct<k:string,v:string>>")
    return F.transform(
        zipped,
        lambda z, k: F.struct(
            k.alias("seq"),
            F.lower(F.regexp_extract(z["r"], r"^<(/?[a-zA-Z][^\s/>]*)", 1)).alias("tag"),
            # End tags and bare start tags carry no attributes: skip the regex work.
            F.when(z["r"].startswith("</") | ~z["r"].rlike(r"^<[a-zA-Z][^\s/>]*[\s/]"), empty)
            .otherwise(tag_attrs(F.regexp_extract(z["r"], r"^<[a-zA-Z][^\s/>]*(.*)>$", 1))).alias("attrs"),
            F.coalesce(z["t"], F.lit("")).alias("text"),
        ),
    )


def tags_in(masked: Column, *names: str, attrs: tuple = ()) -> Column:
    """Only the start tags named of masked markup, with their attributes or only the ``attrs`` named (no text runs).

    For extractors that need attribute values only: one targeted regex instead
    of parsing every tag. Entries look like those of ``element_array``
    (``seq`` is the position among the matched tags)."""
    alt = "|".join(names)
    pattern = rf"(?i)<({alt})(?=[\s/>]){_Q}>"
    raw = F.regexp_extract_all(masked, F.lit(pattern), 0)
    return F.transform(
        raw,
        lambda r, k: F.struct(
            k.alias("seq"),
            F.lower(F.regexp_extract(r, r"^<([a-zA-Z][^\s/>]*)", 1)).alias("tag"),
            tag_attrs(F.regexp_extract(r, r"^<[a-zA-Z][^\s/>]*(.*)>$", 1), attrs).alias("attrs"),
            F.lit("").alias("text"),
        ),
    )


def start_tags(html: Column, *names: str, attrs: tuple = ()) -> Column:
    return tags_in(mask_html(html), *names, attrs=attrs)


TITLE_RE = rf"(?is)<title(?=[\s/>]){_Q}>(.*?(?=</title[\s/>])|(?:[^<]|<(?![a-zA-Z/]))*+)"


def run_text(markup: Column) -> Column:
    """``tag.get_text().strip()`` of inner markup."""
    return node_text(F.regexp_replace(markup, TAG_RE, ""))


def title_text(masked: Column) -> Column:
    """Text of the first title: up to its end tag, or without one up to the next tag ('' without a title)."""
    return run_text(F.regexp_extract(masked, TITLE_RE, 1))


# ---- element accessors (usable inside higher-order lambdas) ---------------------

def attr(e: Column, name: str) -> Column:
    """Attribute value or NULL when the attribute is absent."""
    return F.try_element_at(F.filter(e["attrs"], lambda a: a["k"] == name), F.lit(-1))["v"]


def has_attr(e: Column, name: str) -> Column:
    return F.exists(e["attrs"], lambda a: a["k"] == name)


def of_tag(el: Column, *tags: str) -> Column:
    if len(tags) == 1:
        return F.filter(el, lambda e: e["tag"] == tags[0])
    return F.filter(el, lambda e: e["tag"].isin(*tags))
