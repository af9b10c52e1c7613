"""Site statistics (A20) and the documented use cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelens.functions.lookups import API_PATTERN, EMAIL_PATTERN, FILE_EXTENSIONS, PHONE_PATTERNS
from sitelens.operators import extract as X
from sitelens.operators import fetch as FT
from sitelens.operators import keywords as K
from sitelens.operators import linkgraph as LG
from sitelens.operators import merge as M
from sitelens.operators import redirects as RD
from sitelens.operators import stats as ST
from sitelens.operators.seo import seo
from sitelens.plans import sqlparts as S
from sitelens.plans.compose import event_fetches, part_pages
from sitelens.plans.extract_plans import EP_SQL, MH
from sitelens.plans.fetch_plans import FETCH_CTE
from sitelens.plans.registry import register
from sitelens.sources.pages import load_pages, read_table

Q = S.sq
FILE_LIKE = " OR ".join(f"contains(lower(h), '{e}')" for e in FILE_EXTENSIONS)

STATS_SQL = f"""
WITH ep AS ({EP_SQL.replace('SELECT page_id, endpoint,', 'SELECT page_id, site, endpoint,', 1)}),
{S.pages_cte()}, {MH}, {S.kw_tokens_cte()},
nocom AS (SELECT site, regexp_replace(html, '(?is)<!--.*?-->|(<script\\b[^>]*>.*?</script\\s*>)', '\\1', 'g') AS h FROM pg),
base AS (SELECT site, count(*) AS total_urls_visited, avg(octet_length(encode(html))) AS average_page_size,
                sum(octet_length(encode(html))) AS total_data_downloaded,
                sum(len(regexp_extract_all(mh, '(?is)<form\\b', 0))) AS forms_found,
                sum(len(regexp_extract_all(mh, '(?is)<img\\b', 0))) AS images_found,
                sum(len(regexp_extract_all(mh, '(?is)<(?:video|iframe)\\b', 0))) AS videos_found,
                sum(len(list_filter(regexp_extract_all(mh, '(?is)<a\\s[^>]*href="([^"]*)"', 1), lambda h: {FILE_LIKE}))) AS files_found
         FROM mh GROUP BY site),
e AS (SELECT site, count(DISTINCT endpoint) AS total_endpoints_found FROM ep WHERE in_scope GROUP BY site),
k AS (SELECT site, count(DISTINCT keyword) AS total_keywords FROM kw GROUP BY site),
em AS (SELECT site, count(DISTINCT x) AS unique_emails FROM (SELECT site, unnest(regexp_extract_all(html, '{Q(EMAIL_PATTERN)}', 0)) AS x FROM pg) GROUP BY site),
ph AS (SELECT site, count(DISTINCT x) AS unique_phones FROM (SELECT site, unnest(list_concat({", ".join(f"regexp_extract_all(html, '{Q(p)}', 0)" for p in PHONE_PATTERNS)})) AS x FROM pg) GROUP BY site),
api AS (SELECT site, count(DISTINCT x) AS api_endpoints FROM (
          SELECT site, regexp_replace(unnest(regexp_extract_all(s, '{Q(API_PATTERN)}', 0)), '^[\"'']+|[\"'']+$', '', 'g') AS x
          FROM (SELECT site, unnest(regexp_extract_all(h, '(?is)<script\\b[^>]*>(.*?)</script\\s*>', 1)) AS s FROM nocom)) GROUP BY site)
SELECT site, total_urls_visited, coalesce(total_endpoints_found, 0) AS total_endpoints_found, coalesce(total_keywords, 0) AS total_keywords,
       coalesce(unique_emails, 0) AS unique_emails, coalesce(unique_phones, 0) AS unique_phones,
       CAST(forms_found AS BIGINT) AS forms_found, CAST(images_found AS BIGINT) AS images_found, CAST(videos_found AS BIGINT) AS videos_found,
       CAST(files_found AS BIGINT) AS files_found, coalesce(api_endpoints, 0) AS api_endpoints,
       round(average_page_size, 6) AS average_page_size, CAST(total_data_downloaded AS BIGINT) AS total_data_downloaded
FROM base LEFT JOIN e USING (site) LEFT JOIN k USING (site) LEFT JOIN em USING (site) LEFT JOIN ph USING (site) LEFT JOIN api USING (site)
"""


@register("site_statistics", STATS_SQL)
def site_statistics(spark, sf_dir):
    """The statistics block of every site of the page store."""
    s = ST.site_statistics(load_pages(spark, sf_dir))
    return s.select(
        "site", *[F.col(c).cast("bigint").alias(c) for c in (
            "total_urls_visited", "total_endpoints_found", "total_keywords", "unique_emails", "unique_phones",
            "forms_found", "images_found", "videos_found", "files_found", "api_endpoints")],
        F.round("average_page_size", 6).alias("average_page_size"), F.col("total_data_downloaded").cast("bigint").alias("total_data_downloaded"),
    )


BROKEN_SQL = f"""
WITH RECURSIVE {FETCH_CTE},
l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY url ORDER BY ts DESC, event_id DESC) = 1),
h AS (SELECT ts, event_id, unnest(redirects) AS src, unnest(list_append(redirects[2:], url)) AS dst FROM f WHERE len(redirects) > 0),
nxt AS (SELECT src, dst FROM h WHERE true QUALIFY row_number() OVER (PARTITION BY src ORDER BY ts DESC, event_id DESC, dst DESC) = 1),
links AS (SELECT '/p/' || p_partkey AS source, CASE WHEN p_partkey % 2 = 0 THEN 'https' ELSE 'http' END
                 || '://site' || (p_partkey % 5) || '.example.com/u/' || (p_partkey % 400) || CASE WHEN p_partkey % 7 = 1 THEN '/' ELSE '' END AS target FROM part),
walk(target, final, hops) AS (
  SELECT DISTINCT target, target, 0 FROM links
  UNION ALL SELECT target, dst, hops + 1 FROM walk JOIN nxt ON src = final WHERE hops < 20),
ends AS (SELECT target, final, hops FROM walk QUALIFY row_number() OVER (PARTITION BY target ORDER BY hops DESC) = 1)
SELECT source, links.target, final, hops::BIGINT AS hops, status_code, error_type,
       CASE WHEN url IS NULL THEN 'missing' WHEN error_type IS NOT NULL THEN 'error' ELSE 'status' END AS reason
FROM links JOIN ends ON ends.target = links.target LEFT JOIN l ON url = final WHERE url IS NULL OR error_type IS NOT NULL OR status_code >= 400
"""


@register("broken_links", BROKEN_SQL)
def broken_links(spark, sf_dir):
    """Links whose redirects end at a URL that was never fetched, or whose latest fetch failed or has an error status."""
    k = F.col("p_partkey")
    scheme = F.when(k % 2 == 0, F.lit("https")).otherwise(F.lit("http"))
    target = F.concat(
        scheme, F.lit("://site"), (k % 5).cast("string"), F.lit(".example.com/u/"), (k % 400).cast("string"), F.when(k % 7 == 1, F.lit("/")).otherwise(F.lit(""))
    )
    links = read_table(spark, sf_dir, "part").select(F.concat(F.lit("/p/"), k.cast("string")).alias("source"), target.alias("target"))
    fetches = event_fetches(spark, sf_dir)
    targets = RD.final_targets(RD.next_hops(fetches))
    return LG.broken_links(links, M.latest_wins(fetches, "url", ["ts", "event_id"]), targets)


DEGREE_SQL = f"""
WITH ep AS ({EP_SQL}), l AS (SELECT p.url, endpoint FROM ep JOIN pages p USING (page_id) WHERE in_scope),
i AS (SELECT endpoint AS url, count(*) AS n FROM l GROUP BY 1), o AS (SELECT url, count(*) AS n FROM l GROUP BY 1)
SELECT url, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree FROM i FULL JOIN o USING (url)
"""


@register("link_degrees", DEGREE_SQL)
def link_degrees(spark, sf_dir):
    """In- and out-degree over the internal links."""
    return LG.degrees(X.endpoints(load_pages(spark, sf_dir)).where("in_scope"))


MOBILE_SQL = """
SELECT 'shop.example.com' AS site, count(*) AS pages, count(*) FILTER (WHERE p_partkey % 2 = 0) AS mobile_friendly,
       round(count(*) FILTER (WHERE p_partkey % 2 = 0) * 100.0 / count(*), 4) AS mobile_share
FROM part
"""


@register("mobile_audit", MOBILE_SQL)
def mobile_audit(spark, sf_dir):
    """D3: share of pages with a viewport meta tag per site."""
    s = seo(part_pages(spark, sf_dir))
    return s.groupBy("site").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if("mobile_friendly").alias("mobile_friendly"),
        F.round(F.count_if("mobile_friendly") * 100.0 / F.count(F.lit(1)), 4).alias("mobile_share"),
    )


SNAP_SQL = """
WITH old AS (SELECT url, sha256(html) AS h FROM pages),
new AS (SELECT url, sha256(CASE WHEN page_id % 3 = 0 THEN html || '<!-- v2 -->' ELSE html END) AS h FROM pages WHERE page_id % 5 <> 0
        UNION ALL SELECT url || '?v2', sha256(html) FROM pages WHERE page_id % 7 = 0)
SELECT coalesce(o.url, n.url) AS url,
       CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' WHEN o.h <> n.h THEN 'changed' ELSE 'unchanged' END AS status
FROM old o FULL JOIN new n ON o.url = n.url
"""


@register("snapshot_diff", SNAP_SQL)
def snapshot_diff(spark, sf_dir):
    """Two snapshots of the page store compared by content hash."""
    p = read_table(spark, sf_dir, "pages")
    new = p.where(F.col("page_id") % 5 != 0).select(
        "url", F.when(F.col("page_id") % 3 == 0, F.concat("html", F.lit("<!-- v2 -->"))).otherwise(F.col("html")).alias("html")
    ).unionByName(p.where(F.col("page_id") % 7 == 0).select(F.concat("url", F.lit("?v2")).alias("url"), "html"))
    return M.snapshot_diff(p.select("url", "html"), new)


RUN_CMP_SQL = f"""
WITH {S.pages_cte()}, {S.kw_tokens_cte()},
o AS (SELECT site, keyword, count(*) AS n FROM kw WHERE page_id % 2 = 0 GROUP BY ALL),
n AS (SELECT site, keyword, count(*) AS n FROM kw WHERE page_id % 2 = 1 GROUP BY ALL)
SELECT coalesce(o.site, n.site) AS site, coalesce(o.keyword, n.keyword) AS keyword,
       coalesce(o.n, 0) AS old_count, coalesce(n.n, 0) AS new_count, coalesce(n.n, 0) - coalesce(o.n, 0) AS delta
FROM o FULL JOIN n ON o.site = n.site AND o.keyword = n.keyword
"""


@register("run_compare", RUN_CMP_SQL)
def run_compare(spark, sf_dir):
    """Keyword counts of two runs side by side."""
    p = load_pages(spark, sf_dir)
    o = K.site_keywords(p.where(F.col("page_id") % 2 == 0)).withColumnRenamed("frequency", "old_count")
    n = K.site_keywords(p.where(F.col("page_id") % 2 == 1)).withColumnRenamed("frequency", "new_count")
    j = o.join(n, ["site", "keyword"], "full").fillna(0, ["old_count", "new_count"])
    return j.select("site", "keyword", "old_count", "new_count", (F.col("new_count") - F.col("old_count")).alias("delta"))


RUN_DOM_SQL = f"""
WITH {FETCH_CTE}
SELECT count(DISTINCT d) AS domains FROM (SELECT {S.host('url')} AS d FROM pages UNION ALL SELECT {S.host('url')} FROM f)
"""


@register("run_domains", RUN_DOM_SQL)
def run_domains(spark, sf_dir):
    """Distinct domains over combined runs (page store + fetch log)."""
    from sitelens.functions.urls import host

    a = read_table(spark, sf_dir, "pages").select(host(F.col("url")).alias("d"))
    b = event_fetches(spark, sf_dir).select(host(F.col("url")).alias("d"))
    return a.unionByName(b).agg(F.count_distinct("d").alias("domains"))
