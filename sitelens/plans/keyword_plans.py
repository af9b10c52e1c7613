"""Keyword queries over the page store: site top-k (flagship) and per-page top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelens.operators import keywords as K
from sitelens.plans import sqlparts as S
from sitelens.plans.registry import register
from sitelens.sources.pages import load_pages

SITE_TOP_SQL = f"""
WITH {S.pages_cte()}, {S.kw_tokens_cte()},
agg AS (SELECT site, keyword, count(*) AS frequency FROM kw GROUP BY site, keyword)
SELECT site, keyword, frequency,
       row_number() OVER (PARTITION BY site ORDER BY frequency DESC, keyword) AS rank
FROM agg QUALIFY rank <= 100
"""


@register("site_top_keywords", SITE_TOP_SQL)
def site_top_keywords(spark, sf_dir):
    """Top-100 keywords of every site."""
    return K.site_top_keywords(load_pages(spark, sf_dir), 100).select(
        "site", "keyword", F.col("frequency").cast("bigint").alias("frequency"), F.col("rank").cast("bigint").alias("rank")
    )


PAGE_TOP_SQL = f"""
WITH {S.pages_cte()}, {S.kw_tokens_cte()},
agg AS (SELECT page_id, url, keyword, count(*) AS frequency, min(pos) AS first_pos
        FROM kw GROUP BY page_id, url, keyword)
SELECT page_id, url, keyword, frequency,
       row_number() OVER (PARTITION BY page_id ORDER BY frequency DESC, first_pos) AS rank
FROM agg QUALIFY rank <= 100
"""


@register("page_top_keywords", PAGE_TOP_SQL)
def page_top_keywords(spark, sf_dir):
    """Per-page most_common(100), ties by first appearance; rank is the row id."""
    return K.page_top_keywords(load_pages(spark, sf_dir), 100).select(
        "page_id", "url", "keyword", F.col("frequency").cast("bigint").alias("frequency"),
        F.col("rank").cast("bigint").alias("rank"),
    )


DISTINCT_SQL = f"""
WITH {S.pages_cte()}, {S.kw_tokens_cte()}
SELECT site, count(DISTINCT keyword) AS total_keywords, count(*) AS kept_tokens FROM kw GROUP BY site
"""


@register("site_keyword_totals", DISTINCT_SQL)
def site_keyword_totals(spark, sf_dir):
    """A3 (keywords): distinct keywords and kept tokens per site."""
    return (
        K.site_keywords(load_pages(spark, sf_dir))
        .groupBy("site")
        .agg(F.count(F.lit(1)).alias("total_keywords"), F.sum("frequency").cast("bigint").alias("kept_tokens"))
    )
