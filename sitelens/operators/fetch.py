"""Fetch-log operators: result projection (F3–F9), histograms and timing (A5–A9,
A17, T6, T7) and the keyed latest-row replace of the ``urls`` table (S8).

A fetch log has one row per fetch attempt: ``url, site, status_code,
content_type, size, depth, response_time, ts, error, error_type, redirects``.
Every aggregate is grouped by ``site`` with map-side partial aggregation, so the
shuffle carries one partial row per (task, group) whatever the skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_type_base(ct: Column) -> Column:
    """the media type before the first ';' (no trimming)."""
    return F.substring_index(F.coalesce(ct, F.lit("")), ";", 1)


def is_html(ct: Column) -> Column:
    """'text/html' contained in the raw Content-Type."""
    return F.coalesce(ct.contains("text/html"), F.lit(False))


def results(fetches: DataFrame) -> DataFrame:
    """One result row per fetch; error rows keep only error, type, depth, ts."""
    ok = F.col("error_type").isNull()
    return fetches.select(
        "*",
        F.when(ok, content_type_base(F.col("content_type"))).alias("content_type_base"),
        F.when(ok, F.col("size") / 1024.0).alias("size_kb"),
        is_html(F.col("content_type")).alias("is_html"),
    )


def redirect_hops(fetches: DataFrame, key: str = "event_id") -> DataFrame:
    """one row per redirect hop, only for fetches that were redirected."""
    r = fetches.where(F.size(F.coalesce(F.col("redirects"), F.array().cast("array<string>"))) > 0)
    return r.select(key, "url", F.posexplode("redirects").alias("hop", "redirect_url"))


def ok_rows(fetches: DataFrame) -> DataFrame:
    return fetches.where(F.col("error_type").isNull())


def status_histogram(fetches: DataFrame) -> DataFrame:
    """Status codes of successful fetches (non-HTML included)."""
    return ok_rows(fetches).groupBy("site", "status_code").agg(F.count(F.lit(1)).alias("n"))


def type_histogram(fetches: DataFrame) -> DataFrame:
    """Normalised content types of successful fetches."""
    return ok_rows(fetches).groupBy("site", content_type_base(F.col("content_type")).alias("content_type")).agg(
        F.count(F.lit(1)).alias("n")
    )


def error_histogram(fetches: DataFrame) -> DataFrame:
    """Errors per type and the per-site total (``error_type`` NULL) via ROLLUP."""
    e = fetches.where(F.col("error_type").isNotNull())
    return e.rollup("site", "error_type").agg(F.count(F.lit(1)).alias("errors")).where(F.col("site").isNotNull())


def timing(fetches: DataFrame) -> DataFrame:
    """Response-time and size statistics (0 when empty) and duration."""
    ok = ok_rows(fetches)
    return ok.groupBy("site").agg(
        F.coalesce(F.avg("response_time"), F.lit(0.0)).alias("average_response_time"),
        F.coalesce(F.min("response_time"), F.lit(0.0)).alias("min_response_time"),
        F.coalesce(F.max("response_time"), F.lit(0.0)).alias("max_response_time"),
        F.coalesce(F.avg("size"), F.lit(0.0)).alias("average_page_size"),
        F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("total_data_downloaded"),
    )


def duration(fetches: DataFrame) -> DataFrame:
    """Crawl time = last − first fetch timestamp, in seconds."""
    return fetches.groupBy("site").agg(
        (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).alias("micros")
    ).select("site", (F.col("micros") / 1e6).alias("total_crawl_time"))


def latest_by_url(fetches: DataFrame, order_cols=("ts", "event_id")) -> DataFrame:
    """Keyed replace, last write wins, for HTML pages only.

    ``max_by`` over a (ts, tiebreak) struct is a partial aggregate, so a URL
    fetched millions of times is reduced map-side before the shuffle instead
    of being sorted in one task as a row_number window would.
    """
    html = fetches.where(is_html(F.col("content_type")) & F.col("error_type").isNull())
    cols = [c for c in html.columns if c != "url"]
    order = F.struct(*[F.col(c) for c in order_cols])
    latest = html.groupBy("url").agg(F.max_by(F.struct(*[F.col(c) for c in cols]), order).alias("r"))
    return latest.select("url", "r.*")


def cookies(headers: Column) -> Column:
    """cookies map (name → value) from the Set-Cookie header(s).

    Several cookies folded into one header are split at commas that start a
    new ``name=`` pair (commas inside an Expires date do not); attributes after
    the first ';' are dropped; a repeated name keeps its last value."""
    sc = F.coalesce(F.try_element_at(F.coalesce(headers, F.create_map().cast("map<string,string>")), F.lit("Set-Cookie")), F.lit(""))
    parts = F.filter(F.split(sc, r",\s*(?=[^;=,\s]+=)"), lambda x: x.contains("="))
    pairs = F.transform(
        parts,
        lambda x: F.struct(
            F.trim(F.substring_index(F.substring_index(x, ";", 1), "=", 1)).alias("k"),
            F.trim(F.regexp_extract(F.substring_index(x, ";", 1), "^[^=]*=(.*)$", 1)).alias("v"),
        ),
    )
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_entries(
        F.transform(keys, lambda k: F.struct(k.alias("k"), F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"].alias("v")))
    )
