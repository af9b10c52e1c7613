"""URL column expressions: netloc, site key, domain normalisation and RFC-3986 joins.

Everything is a JVM expression (no Python UDF): relative-reference resolution,
including dot-segment removal, is a fold over the path segments.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelens.functions.lookups import SUBDOMAIN_LABELS
from sitelens.functions.text import let

SCHEME_RE = r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"
ORIGIN_RE = r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)"
NETLOC_RE = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)"
PATH_RE = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)"


#: FIXED VALUES: second-level labels under which country registries register sites.
REGISTRY_LABELS = "ac|co|com|edu|gob|gov|go|ltd|mil|ne|net|nom|or|org|plc|sch"


def netloc(url: Column) -> Column:
    """``urlparse(url).netloc`` (with port and user info; '' when absent)."""
    return F.regexp_extract(url, NETLOC_RE, 1)


def host(url: Column) -> Column:
    """Lower-cased host name without user info and port."""
    return F.lower(F.regexp_extract(netloc(url), r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)", 1))


def site_pattern() -> str:
    """A label to drop, unless what is left would be a registry suffix such as ``co.uk``."""
    labels = "|".join(SUBDOMAIN_LABELS)
    return rf"^(?:{labels})\.(?!(?:{REGISTRY_LABELS})\.[a-z][a-z]$)([^.]+\..+)$"


def site_of(url: Column) -> Column:
    """Site key of a page: its host with one leading well-known subdomain label
    (``www.``, ``m.``, ``blog.`` …, the enumeration word list) removed, so that
    ``blog.a.example.net`` and ``a.example.net`` are crawled as one target."""
    return F.regexp_replace(host(url), site_pattern(), "$1")


def normalise_domain(raw: Column) -> Column:
    """Command-line domain normalisation (F10): drop ``http://``, ``https://``
    and every ``www.``, keep the text before the first ``/``."""
    c = F.replace(raw, F.lit("http://"), F.lit(""))
    c = F.replace(c, F.lit("https://"), F.lit(""))
    c = F.replace(c, F.lit("www."), F.lit(""))
    return F.substring_index(c, "/", 1)


def _remove_dots(segments: Column) -> Column:
    """Resolve '.' and '..' over a segment array like ``urljoin`` does."""
    folded = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(
            s == "..",
            F.when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc),
        )
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    last = F.element_at(segments, -1)
    folded = F.when(last.isin(".", ".."), F.concat(folded, F.array(F.lit("")))).otherwise(folded)
    joined = F.array_join(folded, "/")
    return (
        F.when(joined == "", F.lit("/"))
        .when(~joined.startswith("/"), F.concat(F.lit("/"), joined))
        .otherwise(joined)
    )


def _bad_netloc(net: Column) -> Column:
    """Brackets that do not hold an IPv6 (or future) address: the URL cannot be parsed."""
    address = net.rlike(r"^(?:[^\[\]]*@)?\[(?:[0-9a-fA-F.]*:[0-9a-fA-F:.]*:[0-9a-fA-F:.]*|v[0-9a-fA-F]+\..+)(?:%[^\]]*)?\](?::.*)?$")
    return net.rlike(r"[\[\]]") & ~address


# References that need no parsing: segments without dots alone, empty ones, controls or signs of a query, fragment, scheme or
# address, behind a base of such segments. ``\z``, since ``$`` also stands before a line end.
_SEGMENT = r"(?!\.{1,2}(?:/|\z))[^\x00-\x20:/?#\[\]]+"
_RELATIVE = rf"{_SEGMENT}(?:/{_SEGMENT})*+/?\z"
_BASE_ORIGIN = r"[a-z][a-z0-9+.\-]*://[!-~&&[^/?#]]*"
_BASE_SEGMENT = r"(?!\.{1,2}/)[!-~&&[^/?#]]+/"
_BASE_FILE = r"[!-~&&[^/?#]]*(?:[?#]|\z)"


def _resolved_as_written(base: Column, href: Column) -> Column:
    """What most references come to by one look at each; NULL for those that must be parsed."""

    def behind(pattern: str, rest: Column) -> Column:
        return let(F.regexp_extract(base, pattern, 1), lambda start: F.when(start != "", F.concat(start, rest)))

    return (
        F.when(href.rlike(rf"^{_RELATIVE}"), behind(rf"^({_BASE_ORIGIN}/(?:{_BASE_SEGMENT})*){_BASE_FILE}", href))
        .when(
            href.rlike(rf"^\.\./{_RELATIVE}"),
            behind(rf"^({_BASE_ORIGIN}/(?:{_BASE_SEGMENT})*){_BASE_SEGMENT}{_BASE_FILE}", F.substring(href, 4, 1 << 30)),
        )
        .when(href.rlike(rf"^/{_RELATIVE}"), behind(rf"^({_BASE_ORIGIN})(?:[/?#]|\z)", href))
        .when(href.rlike(r"^https?://[^\x00-\x20/?#\[\]]+(?:/[^\x00-\x20?#]*)?\z") & base.isNotNull(), href)
    )


def resolve(base: Column, href: Column) -> Column:
    """``urllib.parse.urljoin(base, href)`` for an absolute http(s) base.

    Leading control characters and spaces, tabs and line ends are not part of a reference; empty
    queries and fragments are dropped; a reference with the base's own scheme but no host
    is relative; one with another scheme stays as it was written; NULL where the host
    cannot be parsed. Trailing slashes are kept (no normalisation).
    """
    def scheme_of(u: Column) -> Column:
        return F.lower(F.regexp_extract(u, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1))

    base_parts = F.struct(
        scheme_of(base).alias("scheme"), netloc(base).alias("net"), F.regexp_extract(base, PATH_RE, 1).alias("path"),
        F.regexp_extract(base, r"^[^?#]*\?([^#]*)", 1).alias("query"),
    )
    clean = F.regexp_replace(href, r"^[\x00-\x20]+|[\t\r\n]", "")

    def without_scheme(c: Column) -> Column:
        return let(scheme_of(c), lambda s: F.struct(
            s.alias("scheme"), F.when(s == "", c).otherwise(F.substring(c, F.length(s) + 2, 1 << 30)).alias("rel")
        ))

    def split(u: Column) -> Column:
        rest = F.regexp_replace(u["rel"], r"^//[^/?#]*", "")
        return let(rest, lambda r: F.struct(
            u["scheme"].alias("scheme"), F.regexp_extract(u["rel"], r"^//([^/?#]*)", 1).alias("net"),
            F.regexp_extract(r, r"^([^?#]*)", 1).alias("path"), F.regexp_extract(r, r"^[^?#]*\?([^#]*)", 1).alias("query"),
            F.regexp_extract(r, r"(?s)^[^#]*#(.*)$", 1).alias("fragment"),
        ))

    # Each part is bound once: the plan stays small and no regex runs twice.
    joined = let(base_parts, lambda b: let(clean, lambda c: let(without_scheme(c), lambda u: let(split(u), lambda h: _join(b, h)))))
    parsed = let(joined, lambda j: F.when(j == OTHER_SCHEME, href).otherwise(j))
    return F.when(href == "", base).otherwise(F.coalesce(_resolved_as_written(base, href), parsed))


OTHER_SCHEME = "\x00"  # no URL: a reference that is kept as it was written


def _join(b: Column, h: Column) -> Column:
    """A reference's parts joined to its base's."""

    def tail(query: Column) -> Column:
        return F.concat(
            F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
            F.when(h["fragment"] != "", F.concat(F.lit("#"), h["fragment"])).otherwise(F.lit("")),
        )

    origin = F.concat(b["scheme"], F.lit("://"), b["net"])
    # Relative path: base directory + href path. The segment fold (empty middle
    # segments dropped, dot segments resolved) runs only when the joined path
    # has a dot segment or an empty segment; otherwise plain concatenation is exact.
    bdir = F.regexp_extract(b["path"], r"^(/.*/|/)?", 1)

    def folded(hpath: Column) -> Column:
        bsegs = F.split(b["path"], "/")
        bdir_segs = F.when(F.element_at(bsegs, -1) != "", F.slice(bsegs, 1, F.greatest(F.size(bsegs) - 1, F.lit(0)))).otherwise(bsegs)

        def merged(segments: Column) -> Column:
            n = F.size(segments)
            middle = F.filter(F.slice(segments, 2, F.greatest(n - 2, F.lit(0))), lambda s: s != "")
            return F.when(n <= 2, segments).otherwise(F.concat(F.slice(segments, 1, 1), middle, F.slice(segments, -1, 1)))

        return let(let(F.concat(bdir_segs, F.split(hpath, "/")), merged), _remove_dots)

    plain = F.concat(F.when(bdir == "", F.lit("/")).otherwise(bdir), h["path"])
    relative = let(plain, lambda j: F.when(j.rlike(r"(^|/)\.\.?(/|$)|//"), folded(h["path"])).otherwise(j))
    rooted = F.when(h["path"].rlike(r"(^|/)\.\.?(/|$)"), let(F.split(h["path"], "/"), _remove_dots)).otherwise(h["path"])
    return (
        F.when(_bad_netloc(h["net"]), F.lit(None).cast("string"))
        .when((h["scheme"] != "") & (h["scheme"] != b["scheme"]), F.lit(OTHER_SCHEME))
        .when(h["net"] != "", F.concat(b["scheme"], F.lit("://"), h["net"], h["path"], tail(h["query"])))
        .when(h["path"] == "", F.concat(origin, b["path"], tail(F.when(h["query"] != "", h["query"]).otherwise(b["query"]))))
        .when(h["path"].startswith("/"), F.concat(origin, rooted, tail(h["query"])))
        .otherwise(F.concat(origin, relative, tail(h["query"])))
    )


def in_scope(url: Column, domain: Column) -> Column:
    """Scope predicate (F11): the target domain occurs in the URL's netloc.

    A substring test, so ``notexample.com`` is in scope of ``example.com``; every
    enumerated subdomain is ``label.domain`` and therefore already covered.
    """
    return F.instr(netloc(url), domain) > 0
