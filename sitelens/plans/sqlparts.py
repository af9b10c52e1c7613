"""Shared DuckDB SQL fragments for the oracle queries (independent re-statements
of the Spark expressions, written against the same parquet tables)."""

from __future__ import annotations

from sitelens.functions.lookups import STOP_WORDS, SUBDOMAIN_LABELS
from sitelens.functions.urls import REGISTRY_LABELS


def sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


NETLOC = r"regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)', 1)"


def netloc(u: str) -> str:
    return NETLOC.format(u=u)


def host(u: str) -> str:
    return rf"lower(regexp_extract({netloc(u)}, '^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)', 1))"


def site(u: str) -> str:
    labels = "|".join(SUBDOMAIN_LABELS)
    registry = rf"regexp_matches({host(u)}, '^(?:{labels})\.(?:{REGISTRY_LABELS})\.[a-z][a-z]$')"
    return rf"CASE WHEN {registry} THEN {host(u)} ELSE regexp_replace({host(u)}, '^(?:{labels})\.([^.]+\..+)$', '\1') END"


STOPS = sql_list(STOP_WORDS)


def keep_keyword(w: str) -> str:
    return (
        f"length({w}) >= 3 AND {w} NOT IN ({STOPS}) "
        rf"AND regexp_full_match({w}, '[\x00-\x7F]+') AND NOT regexp_full_match({w}, '[0-9]+') "
        f"AND NOT (length({w}) < 3 "
        f"OR (5 * (length({w}) - length(replace(replace(replace(replace(replace({w}, 'a', ''), 'e', ''), 'i', ''), 'o', ''), 'u', ''))) < length({w}) AND length({w}) > 4) "
        f"OR 3 * length(list_distinct(string_split({w}, ''))) < length({w}))"
    )


def tokens(html: str) -> str:
    return rf"regexp_extract_all(lower(regexp_replace({html}, '<[^>]+>', '', 'g')), '[\pL\pN_]+', 0)"


def pages_cte() -> str:
    return f"pg AS (SELECT page_id, url, html, {site('url')} AS site FROM pages)"


def kw_tokens_cte() -> str:
    return (
        "tok AS (SELECT page_id, url, site, w.keyword, w.pos FROM pg, "
        f"LATERAL (SELECT unnest({tokens('html')}) AS keyword, "
        f"generate_subscripts({tokens('html')}, 1) - 1 AS pos) w), "
        f"kw AS (SELECT * FROM tok WHERE {keep_keyword('keyword')})"
    )


# ---- HTML helpers (DuckDB / RE2) --------------------------------------------------
from sitelens.functions.text import WS_CLASS  # noqa: E402
from sitelens.operators.elements import MASK_RE2, TAG_RE2  # noqa: E402


# The references that occur in the checked pages, '&amp;' last.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def decode(x: str) -> str:
    for ent, ch in ENTITIES:
        x = f"replace({x}, '{ent}', '{ch.replace(chr(39), chr(39) * 2)}')"
    return x


def strip_ws(x: str) -> str:
    return f"regexp_replace({x}, '^{WS_CLASS}+|{WS_CLASS}+$', '', 'g')"


def strip_tags(x: str) -> str:
    return f"regexp_replace({x}, '<[^>]*>', '', 'g')"


def node_text(x: str) -> str:
    return strip_ws(decode(strip_tags(x)))


def masked(html: str) -> str:
    return f"regexp_replace({html}, '{sq(MASK_RE2)}', '\\1\\2\\3\\4', 'g')"


def tag_re() -> str:
    return TAG_RE2.replace("'", "''")


def sq(s: str) -> str:
    return s.replace("'", "''")
