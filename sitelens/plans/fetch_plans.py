"""Fetch-log queries over a log derived from ``events``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sitelens.operators import fetch as FT
from sitelens.plans.compose import ERROR_TYPES, EVENT_FETCH, event_fetches
from sitelens.plans.registry import register


def _status_case() -> str:
    return "CASE event_type " + " ".join(f"WHEN '{et}' THEN {c}" for et, (c, _) in EVENT_FETCH.items()) + " END"


def _type_case() -> str:
    return "CASE event_type " + " ".join(f"WHEN '{et}' THEN '{t}'" for et, (_, t) in EVENT_FETCH.items()) + " END"


K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
ERR_LIST = "[" + ", ".join(f"'{x}'" for x in ERROR_TYPES) + "]"
FETCH_CTE = f"""f AS (
  SELECT event_id, 'https://site' || (user_id % 5) || '.example.com/u/' || user_id AS url,
         'site' || (user_id % 5) || '.example.com' AS site,
         CASE WHEN event_type <> 'error' THEN {_status_case()} END AS status_code,
         CASE WHEN event_type <> 'error' THEN {_type_case()} END AS content_type,
         CASE WHEN event_type <> 'error' THEN {K} * 37 + 100 END AS size,
         CAST(event_id % 4 AS INTEGER) AS depth,
         CASE WHEN event_type <> 'error' THEN value / 100.0 END AS response_time, ts,
         CASE WHEN event_type = 'error' THEN {ERR_LIST}[{K} % 3 + 1] END AS error_type,
         CASE WHEN event_type = 'purchase' THEN ['http://site' || (user_id % 5) || '.example.com/u/' || user_id]
              WHEN event_type = 'click' AND {K} % 10 = 0 THEN ['http://site' || (user_id % 5) || '.example.com/u/' || user_id,
                                                                'http://site' || (user_id % 5) || '.example.com/u/' || user_id || '/']
              ELSE [] END AS redirects
  FROM events)"""


RESULTS_SQL = f"""
WITH {FETCH_CTE}
SELECT event_id, url, status_code, CASE WHEN error_type IS NULL THEN split_part(content_type, ';', 1) END AS content_type_base,
       size, round(size / 1024.0, 6) AS size_kb, depth, round(response_time, 6) AS response_time, error_type,
       coalesce(contains(content_type, 'text/html'), false) AS is_html
FROM f
"""


@register("fetch_results", RESULTS_SQL)
def fetch_results(spark, sf_dir):
    """Result rows (normalised type, size in KB; error rows keep only error fields)."""
    r = FT.results(event_fetches(spark, sf_dir))
    return r.select(
        "event_id", "url", "status_code", "content_type_base", "size", F.round("size_kb", 6).alias("size_kb"), "depth",
        F.round("response_time", 6).alias("response_time"), "error_type", "is_html",
    )


@register("html_only", f"WITH {FETCH_CTE} SELECT event_id, url FROM f WHERE contains(content_type, 'text/html')")
def html_only(spark, sf_dir):
    """fetches whose Content-Type contains text/html."""
    return event_fetches(spark, sf_dir).where(FT.is_html(F.col("content_type"))).select("event_id", "url")


REDIRECT_SQL = f"""
WITH {FETCH_CTE}
SELECT event_id, url, CAST(generate_subscripts(redirects, 1) - 1 AS INTEGER) AS hop, unnest(redirects) AS redirect_url FROM f
"""


@register("redirect_hops", REDIRECT_SQL)
def redirect_hops(spark, sf_dir):
    """redirect chain per fetch, only when non-empty."""
    return FT.redirect_hops(event_fetches(spark, sf_dir))


@register(
    "status_histogram",
    f"WITH {FETCH_CTE} SELECT site, status_code, count(*) AS n FROM f WHERE error_type IS NULL GROUP BY ALL",
)
def status_histogram(spark, sf_dir):
    """A7 + T7: status-code histogram per site (errors excluded)."""
    return FT.status_histogram(event_fetches(spark, sf_dir))


TYPE_TOP_SQL = f"""
WITH {FETCH_CTE},
h AS (SELECT site, split_part(content_type, ';', 1) AS content_type, count(*) AS n FROM f WHERE error_type IS NULL GROUP BY ALL)
SELECT site, content_type, n, row_number() OVER (PARTITION BY site ORDER BY n DESC, content_type) AS rank FROM h QUALIFY rank <= 10
"""


@register("type_top10", TYPE_TOP_SQL)
def type_top10(spark, sf_dir):
    """A8 + T6: content types by count, top 10 per site."""
    h = FT.type_histogram(event_fetches(spark, sf_dir))
    w = Window.partitionBy("site").orderBy(F.col("n").desc(), F.col("content_type"))
    return h.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= 10)


ERR_SQL = f"""
WITH {FETCH_CTE}
SELECT site, error_type, count(*) AS errors FROM f WHERE error_type IS NOT NULL
GROUP BY ROLLUP (site, error_type) HAVING site IS NOT NULL
"""


@register("error_histogram", ERR_SQL)
def error_histogram(spark, sf_dir):
    """Errors per type plus the per-site total (error_type NULL)."""
    return FT.error_histogram(event_fetches(spark, sf_dir))


TIMING_SQL = f"""
WITH {FETCH_CTE}
SELECT site, round(avg(response_time), 6) AS average_response_time, round(min(response_time), 6) AS min_response_time,
       round(max(response_time), 6) AS max_response_time, round(avg(size), 6) AS average_page_size,
       CAST(sum(size) AS BIGINT) AS total_data_downloaded
FROM f WHERE error_type IS NULL GROUP BY site
"""


@register("response_time_stats", TIMING_SQL)
def response_time_stats(spark, sf_dir):
    """A5 + A6: response-time avg/min/max and page-size avg/total per site."""
    t = FT.timing(event_fetches(spark, sf_dir))
    return t.select(
        "site", *[F.round(c, 6).alias(c) for c in ("average_response_time", "min_response_time", "max_response_time", "average_page_size")],
        "total_data_downloaded",
    )


DUR_SQL = f"""
WITH {FETCH_CTE}
SELECT site, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS total_crawl_time FROM f GROUP BY site
"""


@register("crawl_duration", DUR_SQL)
def crawl_duration(spark, sf_dir):
    """Last − first fetch time per site, in seconds."""
    d = FT.duration(event_fetches(spark, sf_dir))
    return d.select("site", F.round("total_crawl_time", 6).alias("total_crawl_time"))


UPSERT_SQL = f"""
WITH {FETCH_CTE}
SELECT url, event_id, status_code, ts FROM f WHERE contains(content_type, 'text/html') AND error_type IS NULL
QUALIFY row_number() OVER (PARTITION BY url ORDER BY ts DESC, event_id DESC) = 1
"""


@register("urls_upsert_latest", UPSERT_SQL)
def urls_upsert_latest(spark, sf_dir):
    """Keyed replace on url, last write wins (HTML pages only)."""
    return FT.latest_by_url(event_fetches(spark, sf_dir)).select("url", "event_id", "status_code", "ts")


STATUS_TYPE_SQL = f"""
WITH {FETCH_CTE}
SELECT status_code, split_part(content_type, ';', 1) AS content_type, count(*) AS n FROM f WHERE error_type IS NULL GROUP BY ALL
"""


@register("status_by_type", STATUS_TYPE_SQL)
def status_by_type(spark, sf_dir):
    """A7 × A8: status code by normalised content type over all sites."""
    ok = FT.ok_rows(event_fetches(spark, sf_dir))
    return ok.groupBy("status_code", FT.content_type_base(F.col("content_type")).alias("content_type")).agg(F.count(F.lit(1)).alias("n"))
