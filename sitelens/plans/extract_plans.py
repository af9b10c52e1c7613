"""Extraction queries over the driver's page store (``pages``) and ``documents``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sitelens.functions.lookups import EMAIL_PATTERN, PHONE_PATTERNS, TECH_FINGERPRINTS
from sitelens.functions.urls import normalise_domain
from sitelens.operators import extract as X
from sitelens.operators.seo import seo
from sitelens.plans import sqlparts as S
from sitelens.plans.registry import register
from sitelens.sources.pages import conform_pages, load_pages, read_table

MH = f"mh AS (SELECT page_id, url, site, html, {S.masked('html')} AS mh FROM pg)"
Q = S.sq


def _first_attr(tag_sql: str, name: str) -> str:
    """Value of a double-quoted attribute inside a captured tag string."""
    return f"""regexp_extract({tag_sql}, '(?:^|\\s){name}\\s*=\\s*"([^"]*)"', 1)"""


# ---- E1–E8 -------------------------------------------------------------------------
META_SQL = f"""
WITH {S.pages_cte()}, {MH},
t AS (SELECT page_id, url, mh,
        CASE WHEN regexp_matches(mh, '(?is)<title(?:\\s[^>]*)?>')
             THEN {S.node_text("regexp_extract(mh, '(?is)<title(?:\\s[^>]*)?>(.*?)</title\\s*>', 1)")} ELSE '' END AS title,
        regexp_extract(mh, '(?is)<html\\b([^>]*)>', 1) AS html_tag,
        regexp_extract(mh, '(?is)<meta\\s[^>]*name="description"[^>]*>', 0) AS desc_tag,
        regexp_extract(mh, '(?is)<meta\\s[^>]*property="og:description"[^>]*>', 0) AS ogd_tag,
        regexp_extract(mh, '(?is)<meta\\s[^>]*name="keywords"[^>]*>', 0) AS kw_tag,
        regexp_extract(mh, '(?is)<link\\s[^>]*rel="canonical"[^>]*>', 0) AS canon_tag
      FROM mh)
SELECT page_id, url, title, title AS seo_title,
       {S.decode(f"CASE WHEN desc_tag <> '' THEN {_first_attr('desc_tag', 'content')} ELSE {_first_attr('ogd_tag', 'content')} END")} AS description,
       {S.decode(_first_attr('kw_tag', 'content'))} AS keywords,
       {S.decode(_first_attr('canon_tag', 'href'))} AS canonical,
       {S.decode(_first_attr('html_tag', 'lang'))} AS language
FROM t
"""


@register("page_titles_meta", META_SQL)
def page_titles_meta(spark, sf_dir):
    """Title (meta title wins), description, keywords, canonical, language."""
    m = X.metadata(load_pages(spark, sf_dir))
    return m.select("page_id", "url", "title", "seo_title", "description", "keywords", "canonical", "language")


# ---- E9 ------------------------------------------------------------------------------
HEAD_SQL = f"WITH {S.pages_cte()}, {MH}\n" + "\nUNION ALL\n".join(
    f"""SELECT page_id, 'h{n}' AS level, CAST(generate_subscripts(regexp_extract_all(mh, '(?is)<h{n}(?:\\s[^>]*)?>(.*?)</h{n}\\s*>', 1), 1) - 1 AS INTEGER) AS ord,
       {S.node_text(f"unnest(regexp_extract_all(mh, '(?is)<h{n}(?:\\s[^>]*)?>(.*?)</h{n}\\s*>', 1))")} AS text FROM mh"""
    for n in range(1, 7)
)


@register("headings", HEAD_SQL)
def headings(spark, sf_dir):
    """All h1..h6 texts, trimmed, in document order per level."""
    return X.headings(load_pages(spark, sf_dir)).select("page_id", "level", "ord", "text")


# ---- E19, F12 ----------------------------------------------------------------------
A_RE = r'(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a\s*>'
LINKS_SQL = f"""
WITH {S.pages_cte()}, {MH},
a AS (SELECT page_id, url AS source_url, site,
        unnest(regexp_extract_all(mh, '{Q(A_RE)}', 1)) AS href,
        unnest(regexp_extract_all(mh, '{Q(A_RE)}', 2)) AS inner_html,
        generate_subscripts(regexp_extract_all(mh, '{Q(A_RE)}', 1), 1) AS sub FROM mh),
f AS (SELECT * FROM a WHERE href <> '')
SELECT page_id, source_url,
       CAST(row_number() OVER (PARTITION BY page_id ORDER BY sub) - 1 AS INTEGER) AS ord,
       {S.decode('href')} AS target_url, {S.node_text('inner_html')} AS anchor_text,
       CASE WHEN instr({S.decode('href')}, site) > 0 THEN 'internal' ELSE 'external' END AS link_type
FROM f
"""


@register("links", LINKS_SQL)
def links(spark, sf_dir):
    """E19 + F12: links table rows (raw href, anchor text, internal/external)."""
    return X.links(load_pages(spark, sf_dir)).select("page_id", "source_url", "ord", "target_url", "anchor_text", "link_type")


LINK_TYPES_SQL = f"""
WITH l AS ({LINKS_SQL.replace('SELECT page_id, source_url,', 'SELECT page_id, source_url, site,', 1)})
SELECT site, link_type, count(*) AS links FROM l GROUP BY site, link_type
"""


@register("link_type_counts", LINK_TYPES_SQL)
def link_type_counts(spark, sf_dir):
    """F12 rollup: links per site and type."""
    return X.links(load_pages(spark, sf_dir)).groupBy("site", "link_type").agg(F.count(F.lit(1)).alias("links"))


# ---- E20–E26 -----------------------------------------------------------------------
def _resolve_sql(base: str, h: str) -> str:
    origin = f"regexp_extract({base}, '^([a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#]*)', 1)"
    bdir = f"regexp_extract({base}, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#]*(/[^?#]*/|/)?', 1)"
    return (
        f"CASE WHEN regexp_matches({h}, '^[a-zA-Z][a-zA-Z0-9+.\\-]*:') THEN {h} "
        f"WHEN starts_with({h}, '//') THEN regexp_extract({base}, '^([a-zA-Z][a-zA-Z0-9+.\\-]*):', 1) || ':' || {h} "
        f"WHEN starts_with({h}, '/') THEN {origin} || {h} "
        f"WHEN starts_with({h}, '#') THEN regexp_extract({base}, '^([^#]*)', 1) || {h} "
        f"WHEN starts_with({h}, '?') THEN regexp_extract({base}, '^([^?#]*)', 1) || {h} "
        f"ELSE {origin} || CASE WHEN {bdir} = '' THEN '/' ELSE {bdir} END || {h} END"
    )


def _cand_sql() -> str:
    from sitelens.functions.lookups import API_PATTERN, COMMENT_URL_PATTERN, JS_URL_PATTERN

    attr_re = {
        "href": r'(?is)<(?:a|link)\s[^>]*href="([^"]*)"',
        "script": r'(?is)<script\s[^>]*src="([^"]*)"',
        "img": r'(?is)<img\s[^>]*src="([^"]*)"',
        "form": r'(?is)<form\s[^>]*action="([^"]*)"',
    }
    parts = [
        f"SELECT page_id, url, site, {S.decode(f'unnest(regexp_extract_all(mh, {chr(39)}{Q(p)}{chr(39)}, 1))')} AS raw FROM mh"
        for p in attr_re.values()
    ]
    scripts = r"(?is)<script\b[^>]*>(.*?)</script\s*>"
    nocom = "regexp_replace(html, '(?is)<!--.*?-->|(<script\\b[^>]*>.*?</script\\s*>)', '\\1', 'g')"
    parts.append(
        f"SELECT page_id, url, site, unnest(regexp_extract_all(s, '{Q(JS_URL_PATTERN)}', 1)) AS raw FROM "
        f"(SELECT page_id, url, site, unnest(regexp_extract_all({nocom}, '{Q(scripts)}', 1)) AS s FROM pg)"
    )
    parts.append(
        f"SELECT page_id, url, site, regexp_replace(unnest(regexp_extract_all(s, '{Q(API_PATTERN)}', 0)), '^[\"'']+|[\"'']+$', '', 'g') AS raw FROM "
        f"(SELECT page_id, url, site, unnest(regexp_extract_all({nocom}, '{Q(scripts)}', 1)) AS s FROM pg)"
    )
    parts.append(
        f"SELECT page_id, url, site, unnest(regexp_extract_all(c, '{Q(COMMENT_URL_PATTERN)}', 0)) AS raw FROM "
        f"(SELECT page_id, url, site, unnest(regexp_extract_all(regexp_replace(html, '(?is)(<script\\b[^>]*>).*?(</script\\s*>)', '\\1\\2', 'g'), '(?s)<!--(.*?)-->', 1)) AS c FROM pg)"
    )
    return " UNION ALL ".join(parts)


EP_SQL = f"""
WITH {S.pages_cte()}, {MH},
c AS (SELECT DISTINCT page_id, url, site, raw FROM ({_cand_sql()}) WHERE raw <> ''),
r AS (SELECT DISTINCT page_id, site, {_resolve_sql('url', 'raw')} AS endpoint FROM c)
SELECT page_id, endpoint, instr({S.netloc('endpoint')}, site) > 0 AS in_scope FROM r
"""


@register("endpoints_in_scope", f"SELECT page_id, endpoint FROM ({EP_SQL}) WHERE in_scope")
def endpoints_in_scope(spark, sf_dir):
    """Distinct resolved in-scope endpoints per page."""
    e = X.endpoints(load_pages(spark, sf_dir))
    return e.where("in_scope").select("page_id", "endpoint")


@register("external_links", f"SELECT page_id, endpoint FROM ({EP_SQL}) WHERE NOT in_scope")
def external_links(spark, sf_dir):
    """Resolved out-of-scope endpoints per page (set)."""
    e = X.endpoints(load_pages(spark, sf_dir))
    return e.where(~F.col("in_scope")).select("page_id", "endpoint")


EP1000_SQL = f"""
WITH e AS (SELECT DISTINCT site, endpoint FROM ({EP_SQL.replace('SELECT page_id, endpoint,', 'SELECT page_id, site, endpoint,', 1)}) WHERE in_scope)
SELECT site, endpoint, row_number() OVER (PARTITION BY site ORDER BY endpoint) AS rank FROM e QUALIFY rank <= 1000
"""


@register("endpoints_first_1000", EP1000_SQL)
def endpoints_first_1000(spark, sf_dir):
    """T3 + A15: sorted distinct in-scope endpoints of each site, first 1000."""
    e = X.endpoints(load_pages(spark, sf_dir)).where("in_scope").select("site", "endpoint").distinct()
    w = Window.partitionBy("site").orderBy("endpoint")
    return e.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= 1000)


# ---- E10, E11 ----------------------------------------------------------------------
def _email_sql(table: str, key: str, text: str) -> str:
    return (
        f"SELECT {key}, CAST(generate_subscripts(regexp_extract_all({text}, '{Q(EMAIL_PATTERN)}', 0), 1) - 1 AS INTEGER) AS pos, "
        f"unnest(regexp_extract_all({text}, '{Q(EMAIL_PATTERN)}', 0)) AS email FROM {table}"
    )


def _phone_sql(table: str, key: str, text: str) -> str:
    arr = "list_concat(" + ", ".join(
        f"list_transform(regexp_extract_all({text}, '{Q(p)}', 0), lambda x: {{'pattern': {i}, 'phone': x}})"
        for i, p in enumerate(PHONE_PATTERNS, start=1)
    ) + ")"
    return (
        f"SELECT {key}, CAST(pos AS INTEGER) AS pos, m.pattern AS pattern, m.phone AS phone FROM "
        f"(SELECT {key}, unnest({arr}) AS m, generate_subscripts({arr}, 1) - 1 AS pos FROM {table})"
    )


@register("emails", _email_sql("pages", "page_id", "html"))
def emails(spark, sf_dir):
    """E-mail addresses in the raw page text (every occurrence, in order)."""
    return X.emails(load_pages(spark, sf_dir)).select("page_id", "pos", "email")


@register("phones", _phone_sql("pages", "page_id", "html"))
def phones(spark, sf_dir):
    """Phone numbers, four patterns concatenated in order."""
    return X.phones(load_pages(spark, sf_dir)).select("page_id", "pos", "pattern", "phone")


def _documents(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return conform_pages(
        d.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("doc://"), F.col("source"), F.lit("/"), F.col("doc_id")).alias("url"),
                 F.col("text").alias("html"), F.col("source").alias("site"))
    )


@register("emails_documents", _email_sql("documents", "doc_id", "text"))
def emails_documents(spark, sf_dir):
    """E10 over ``documents`` text."""
    return X.emails(_documents(spark, sf_dir)).select(F.col("page_id").alias("doc_id"), "pos", "email")


@register("phones_documents", _phone_sql("documents", "doc_id", "text"))
def phones_documents(spark, sf_dir):
    """E11 over ``documents`` text."""
    return X.phones(_documents(spark, sf_dir)).select(F.col("page_id").alias("doc_id"), "pos", "pattern", "phone")


UNIQUE_CONTACTS_SQL = f"""
WITH {S.pages_cte()},
e AS (SELECT site, unnest(regexp_extract_all(html, '{Q(EMAIL_PATTERN)}', 0)) AS v FROM pg),
p AS (SELECT site, unnest(list_concat({", ".join(f"regexp_extract_all(html, '{Q(p)}', 0)" for p in PHONE_PATTERNS)})) AS v FROM pg),
s AS (SELECT DISTINCT site FROM pg)
SELECT s.site, coalesce(ue, 0) AS unique_emails, coalesce(up, 0) AS unique_phones FROM s
LEFT JOIN (SELECT site, count(DISTINCT v) AS ue FROM e GROUP BY site) USING (site)
LEFT JOIN (SELECT site, count(DISTINCT v) AS up FROM p GROUP BY site) USING (site)
"""


@register("unique_contacts", UNIQUE_CONTACTS_SQL)
def unique_contacts(spark, sf_dir):
    """A3 (emails, phones): distinct contacts per site."""
    pages = load_pages(spark, sf_dir)
    sites = pages.select("site").distinct()
    e = X.emails(pages).groupBy("site").agg(F.count_distinct("email").alias("unique_emails"))
    p = X.phones(pages).groupBy("site").agg(F.count_distinct("phone").alias("unique_phones"))
    return (
        sites.join(e, "site", "left").join(p, "site", "left")
        .select("site", F.coalesce("unique_emails", F.lit(0)).alias("unique_emails"), F.coalesce("unique_phones", F.lit(0)).alias("unique_phones"))
    )


# ---- E32, F18 ----------------------------------------------------------------------
TEXT_SQL = f"""
WITH {S.pages_cte()}
SELECT page_id, left({S.decode(f"regexp_replace({S.masked('html')}, '{S.tag_re()}|<![^>]*>|<\\?[^>]*>', '', 'g')")}, 10000) AS text FROM pg
"""


@register("page_text_prefix", TEXT_SQL)
def page_text_prefix(spark, sf_dir):
    """E32 + F18: visible page text, first 10 000 characters."""
    return X.page_text(load_pages(spark, sf_dir)).select("page_id", "text")


# ---- Q1–Q9 -------------------------------------------------------------------------
SEO_SQL = f"""
WITH m AS ({META_SQL}), {S.pages_cte()}, {MH},
x AS (SELECT page_id, url, site, html,
        len(regexp_extract_all(mh, '(?is)<h1(?:\\s[^>]*)?>', 0)) AS h1_count,
        len(regexp_extract_all(mh, '(?is)<img\\b[^>]*>', 0)) AS images_total,
        len(regexp_extract_all(mh, '(?is)<img\\b[^>]*>', 0)) - len(regexp_extract_all(mh, '(?is)<img\\s[^>]*alt="[^"]+"[^>]*>', 0)) AS images_without_alt,
        list_transform(regexp_extract_all(mh, '(?is)<a\\s[^>]*href="([^"]*)"', 1), lambda h: {S.decode('h')}) AS hrefs,
        regexp_matches(mh, '(?is)<meta\\s[^>]*name="viewport"') AS mobile_friendly
      FROM mh)
SELECT x.page_id, length(m.seo_title) AS title_length, length(m.seo_title) BETWEEN 50 AND 60 AS title_optimal,
       h1_count, h1_count = 1 AS h1_optimal, images_total, images_without_alt,
       CASE WHEN images_total > 0 THEN round((images_total - images_without_alt) * 100.0 / images_total, 4) ELSE 0.0 END AS alt_percentage,
       octet_length(encode(html)) AS page_bytes, round(octet_length(encode(html)) / 1024.0, 4) AS page_kb,
       octet_length(encode(html)) < 3145728 AS page_size_optimal,
       starts_with(x.url, 'https') AS https, mobile_friendly,
       len(hrefs) AS links_total, len(list_filter(hrefs, lambda h: instr(h, site) > 0)) AS links_internal,
       len(hrefs) - len(list_filter(hrefs, lambda h: instr(h, site) > 0)) AS links_external
FROM x JOIN m USING (page_id)
"""


@register("seo_audit", SEO_SQL)
def seo_audit(spark, sf_dir):
    """Q1–Q9 (Q10 row): SEO facts per page."""
    s = seo(load_pages(spark, sf_dir))
    return s.select(
        "page_id", F.length("title_text").cast("bigint").alias("title_length"), "title_optimal",
        F.col("h1_count").cast("bigint").alias("h1_count"), "h1_optimal",
        F.col("images_total").cast("bigint").alias("images_total"), F.col("images_without_alt").cast("bigint").alias("images_without_alt"),
        F.round("alt_percentage", 4).alias("alt_percentage"),
        "page_bytes", F.round("page_kb", 4).alias("page_kb"), "page_size_optimal", "https", "mobile_friendly",
        F.col("links_total").cast("bigint").alias("links_total"), F.col("links_internal").cast("bigint").alias("links_internal"),
        F.col("links_external").cast("bigint").alias("links_external"),
    )


SEO100_SQL = """
SELECT page_id, url, row_number() OVER (ORDER BY page_id) AS rank FROM pages QUALIFY rank <= 100
"""


@register("seo_first_100", SEO100_SQL)
def seo_first_100(spark, sf_dir):
    """Q10 + T4: the first 100 SEO rows in crawl order (page_id order in a page store)."""
    s = seo(load_pages(spark, sf_dir)).select("page_id", "url")
    top = s.orderBy("page_id").limit(100)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("page_id")).cast("bigint"))


# ---- E27 ---------------------------------------------------------------------------
TECH_SQL = " UNION ALL ".join(
    f"SELECT page_id, '{t}' AS technology FROM pages WHERE regexp_matches(html, '(?i)({Q(p)})')" for t, p in TECH_FINGERPRINTS
)


@register("technologies_html", TECH_SQL)
def technologies_html(spark, sf_dir):
    """E27 + J7: technologies fingerprinted in the HTML of each page."""
    return X.technologies(load_pages(spark, sf_dir)).select("page_id", "technology")


# ---- F10, D8 -----------------------------------------------------------------------
@register(
    "domain_normalise",
    "SELECT page_id, split_part(replace(replace(replace(url, 'http://', ''), 'https://', ''), 'www.', ''), '/', 1) AS domain FROM pages",
)
def domain_normalise(spark, sf_dir):
    """command-line style domain normalisation of every page URL."""
    return read_table(spark, sf_dir, "pages").select("page_id", normalise_domain(F.col("url")).alias("domain"))


INVENTORY_SQL = f"""
WITH {S.pages_cte()}, {MH}
SELECT site, count(*) AS pages, count(DISTINCT {S.host('url')}) AS hosts, CAST(sum(octet_length(encode(html))) AS BIGINT) AS bytes,
       CAST(sum(len(regexp_extract_all(mh, '(?is)<a\\s[^>]*href="([^"]*)"', 1))) AS BIGINT) AS anchors
FROM mh GROUP BY site
"""


@register("site_inventory", INVENTORY_SQL)
def site_inventory(spark, sf_dir):
    """Inventory per site (pages, hosts, bytes, anchors)."""
    from sitelens.functions.urls import host
    from sitelens.operators.elements import has_attr, of_tag

    p = X.ensure_elements(load_pages(spark, sf_dir))
    n_a = F.size(F.filter(of_tag(F.col("el"), "a"), lambda e: has_attr(e, "href")))
    return p.groupBy("site").agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_distinct(host(F.col("url"))).alias("hosts"),
        F.sum(F.octet_length("html")).cast("bigint").alias("bytes"),
        F.sum(n_a).cast("bigint").alias("anchors"),
    )
