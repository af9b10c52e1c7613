"""Details that the stored pages lack, on pages composed from ``part`` columns; the expected
values come from the columns. Covers E4, E9 below h1, E21–E23, Q2, Q6, T4, tags with many
attributes, character references and unusual hrefs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelens.operators import extract as X
from sitelens.operators import seo as SEO
from sitelens.plans.compose import SHOP
from sitelens.plans.registry import register
from sitelens.sources.pages import conform_pages, dealt, read_table

MANY = " ".join(f'data-{i}="v>{i}"' for i in range(60))


def detail_pages(spark, sf_dir):
    p = dealt(read_table(spark, sf_dir, "part"), "p_partkey")
    ks, name, brand, typ = F.col("p_partkey").cast("string"), F.col("p_name"), F.col("p_brand"), F.col("p_type")
    html = F.concat(
        F.lit("<html><head><title>"), name, F.lit(" &eacute;&#38;lt;&rarr; &#65</title>"),
        F.lit('<meta name="keywords" content="'), brand, F.lit(", "), typ, F.lit('">'),
        F.lit('<meta name="description" content="'), F.repeat(F.lit("d"), (100 + F.col("p_partkey") % 100).cast("int")), F.lit('">'),
        F.lit("<script>load(\"/app/"), ks, F.lit(".php\"); get('/api/v2/items/"), ks, F.lit("'); get(\"v1/list/"), ks, F.lit("\");</script>"),
        F.lit("<!-- see https://cdn.example.com/c/"), ks, F.lit(" and www.other"), ks, F.lit(".com --></head><body>"),
        *[x for n in range(1, 7) for x in (F.lit(f"<h{n} class=t>"), name, F.lit(f" <i>{n}</i></h{n}>"))],
        F.lit(f"<img {MANY} src='a>"), ks, F.lit(".png' alt='&quot;"), brand, F.lit("&copy'>"),
        F.lit('<a href="#">top</a><a href=" /x'), ks, F.lit('?">x</a><a href="HTTPS://www.shop.example.com/u'), ks,
        F.lit('">u</a><a href="https:rel'), ks, F.lit('">r</a><a href="http://[bad">b</a></body></html>'),
    )
    return conform_pages(p.select(
        F.col("p_partkey").alias("page_id"), F.concat(F.lit(f"{SHOP}/d/"), ks).alias("url"), html.alias("html"),
        (F.col("p_partkey") % 5).cast("double").alias("elapsed"),
    ))


@register("page_details", """
SELECT p_partkey AS page_id, p_name || ' é&lt;→ A' AS title, p_brand || ', ' || p_type AS keywords FROM part
""")
def page_details(spark, sf_dir):
    """Titles with references of every kind, and meta keywords."""
    return X.metadata(detail_pages(spark, sf_dir)).select("page_id", "title", "keywords")


@register("heading_levels", """
SELECT p_partkey AS page_id, 'h' || n AS level, 0 AS ord, p_name || ' ' || n AS text FROM part, range(1, 7) t(n)
""")
def heading_levels(spark, sf_dir):
    """All six levels."""
    return X.headings(detail_pages(spark, sf_dir)).select("page_id", "level", "ord", "text")


@register("script_and_comment_urls", """
SELECT p_partkey AS page_id, 'js' AS kind, '/app/' || p_partkey || '.php' AS raw FROM part
UNION ALL SELECT p_partkey, 'api', '/api/v2/items/' || p_partkey FROM part
UNION ALL SELECT p_partkey, 'api', 'v1/list/' || p_partkey FROM part
UNION ALL SELECT p_partkey, 'comment', 'https://cdn.example.com/c/' || p_partkey FROM part
UNION ALL SELECT p_partkey, 'comment', 'www.other' || p_partkey || '.com' FROM part
""")
def script_and_comment_urls(spark, sf_dir):
    """URLs in inline scripts, API endpoints, URLs in comments."""
    found = X.endpoint_candidates(detail_pages(spark, sf_dir)).where(F.col("kind").isin("js", "api", "comment"))
    return found.select("page_id", "kind", "raw")


@register("long_tags", f"""
SELECT p_partkey AS page_id, '{SHOP}/d/a>' || p_partkey || '.png' AS src, '"' || p_brand || '©' AS alt FROM part
""")
def long_tags(spark, sf_dir):
    """E15 on tags with more than 60 quoted attributes, '>' inside each."""
    return X.images(detail_pages(spark, sf_dir)).select("page_id", "src", "alt")


@register("unusual_hrefs", f"""
SELECT p_partkey AS page_id, '{SHOP}/d/' || p_partkey AS endpoint FROM part
UNION ALL SELECT p_partkey, '{SHOP}/x' || p_partkey FROM part
UNION ALL SELECT p_partkey, '{SHOP}/u' || p_partkey FROM part
UNION ALL SELECT p_partkey, '{SHOP}/d/rel' || p_partkey FROM part
""")
def unusual_hrefs(spark, sf_dir):
    """Empty fragment and query, leading space, upper-case and bare scheme, a host that cannot be parsed."""
    found = X.links(detail_pages(spark, sf_dir))
    from sitelens.functions.urls import resolve

    joined = found.select("page_id", resolve(F.col("source_url"), F.col("target_url")).alias("endpoint"))
    return joined.where(F.col("endpoint").isNotNull())


SEO_SQL = f"""
SELECT p_partkey AS page_id, '{SHOP}/d/' || p_partkey AS url, 100 + p_partkey % 100 AS description_length,
       100 + p_partkey % 100 BETWEEN 150 AND 160 AS description_optimal, CAST(p_partkey % 5 AS DOUBLE) AS response_seconds,
       p_partkey % 5 < 3 AS response_time_optimal, length(p_name) + 9 AS title_length, 1 AS h1_count, 5 AS links_total
FROM part
"""
SEO_COLUMNS = ["page_id", "url", "description_length", "description_optimal", "response_seconds", "response_time_optimal", "title_length", "h1_count", "links_total"]


@register("seo_description_response", SEO_SQL)
def seo_description_response(spark, sf_dir):
    """Q2, Q6: description length and response time."""
    return SEO.seo(detail_pages(spark, sf_dir)).select(*SEO_COLUMNS)


@register("seo_facts_first_100", f"{SEO_SQL} ORDER BY page_id LIMIT 100")
def seo_facts_first_100(spark, sf_dir):
    """Q10, T4: the SEO facts of the first 100 pages."""
    return SEO.seo(detail_pages(spark, sf_dir)).select(*SEO_COLUMNS).orderBy("page_id").limit(100)
