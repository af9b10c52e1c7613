"""Crawl driver (G2, J2), first files per type (T5, A13) and social merge."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sitelens.operators import extract as X
from sitelens.operators import merge as M
from sitelens.operators import traverse as TR
from sitelens.plans.compose import FILE_SAMPLES, SHOP, SOCIAL_SAMPLES, part_pages, tree_pages
from sitelens.plans.registry import register
from sitelens.sources.pages import conform_pages

# Page k of the tree lies at the depth that the fan-out f gives; three levels below the root hold all parts.
TREE_CTE = """c AS (SELECT floor(count(*) ** (1.0 / 3) + 1e-6)::BIGINT + 2 AS f FROM part),
tree AS (SELECT p_partkey, CASE WHEN p_partkey = 0 THEN 0 WHEN p_partkey <= f THEN 1 WHEN p_partkey <= f + f * f THEN 2 ELSE 3 END AS depth FROM part, c)"""
CRAWL_SQL = f"WITH {TREE_CTE} SELECT '{SHOP}/t/' || p_partkey || '/index.html' AS url, depth, p_partkey AS page_id FROM tree"


@register("crawl_site", CRAWL_SQL)
def crawl_site(spark, sf_dir):
    """G2 + J2 + G1: crawl the stored pages from the root to depth 3; result rows
    are the visited URLs joined to the page store."""
    pages = tree_pages(spark, sf_dir)
    seeds = spark.range(1).select(F.lit(f"{SHOP}/t/0/index.html").alias("url"))
    results, _ = TR.crawl(pages, seeds, max_depth=3)
    return results.select("url", F.col("depth").cast("int").alias("depth"), "page_id")


CRAWL_STATS_SQL = f"""
WITH {TREE_CTE}, levels AS (SELECT depth, count(*) AS n FROM tree GROUP BY depth)
SELECT 'shop.example.com' AS site, 1 + sum(n)::BIGINT AS total_urls_visited, sum(n)::BIGINT AS total_endpoints_found,
       1::BIGINT AS total_subdomains_found, greatest(2, max(n))::BIGINT AS peak_queue_size
FROM levels
"""


@register("crawl_statistics", CRAWL_STATS_SQL)
def crawl_statistics(spark, sf_dir):
    """Domain → subdomains → seeds → crawl to depth 4 → statistics. The stored front page of the found
    subdomain leads to the page tree; the bare domain is visited but not stored."""
    one = spark.range(1)
    front = conform_pages(one.select(
        F.lit(-1).cast("long").alias("page_id"), F.lit(SHOP).alias("url"),
        F.lit('<a href="/t/0/index.html">start</a>').alias("html"), F.lit("text/html").alias("content_type"), F.lit(200).alias("status_code"),
    ))
    pages = tree_pages(spark, sf_dir).unionByName(front)
    domains = one.select(F.lit("shop.example.com").alias("site"))
    dns = one.select(F.lit("www.shop.example.com").alias("name"), F.lit("10.0.0.1").alias("ip"), F.lit(0).alias("pos"))
    _, stats, _ = TR.crawl_domains(pages, domains, dns, max_depth=4)
    names = ["total_urls_visited", "total_endpoints_found", "total_subdomains_found", "peak_queue_size"]
    return stats.select("site", *[F.col(c).cast("long").alias(c) for c in names])


def _files_sql() -> str:
    types = " ".join(f"WHEN {i} THEN {repr(t) if t else 'NULL'}" for i, (_, t) in enumerate(FILE_SAMPLES))
    cases = " ".join(f"WHEN {i} THEN '{s}'" for i, (s, _) in enumerate(FILE_SAMPLES))
    return f"""
WITH f AS (SELECT p_partkey, CASE p_partkey % {len(FILE_SAMPLES)} {types} END AS file_type,
                  '{SHOP}/p/docs/' || p_partkey || CASE p_partkey % {len(FILE_SAMPLES)} {cases} END AS file_path FROM part)
SELECT file_type, file_path, row_number() OVER (PARTITION BY file_type ORDER BY p_partkey) AS rank,
       count(*) OVER (PARTITION BY file_type) AS files
FROM f WHERE file_type IS NOT NULL QUALIFY rank <= 20
"""


@register("files_first_20", _files_sql())
def files_first_20(spark, sf_dir):
    """A13 + T5: files per type (count) and the first 20 in crawl order."""
    f = X.files(part_pages(spark, sf_dir))
    w = Window.partitionBy("file_type").orderBy("page_id", "seq")
    counts = f.groupBy("file_type").agg(F.count(F.lit(1)).alias("files"))
    first = f.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 20)
    return first.join(counts, "file_type").select("file_type", "file_path", F.col("rank").cast("bigint").alias("rank"), "files")


def _social_merge_sql() -> str:
    rows = []
    for i, (host, plats) in enumerate(SOCIAL_SAMPLES):
        for p in plats:
            rows.append(f"SELECT '{p}' AS platform, 'https://{host}/' || p_brand AS link FROM part WHERE p_partkey % {len(SOCIAL_SAMPLES)} = {i}")
    return f"SELECT DISTINCT 'shop.example.com' AS site, platform, link FROM ({' UNION ALL '.join(rows)})"


@register("merge_social", _social_merge_sql())
def merge_social(spark, sf_dir):
    """Social links of two runs united per platform (platforms of either run kept)."""
    p = part_pages(spark, sf_dir)
    old = X.social_links(p.where(F.col("page_id") % 2 == 0)).select("site", "platform", "link")
    new = X.social_links(p.where(F.col("page_id") % 2 == 1)).select("site", "platform", "link")
    return M.append_runs(old, new).distinct()
