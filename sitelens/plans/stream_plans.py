"""Streaming queries (X1–X5) over the event log arriving as files.

The table is laid out once as range-ordered files in a scratch folder (simulated
arrival order), in slices of as many files as their rows need; each query streams them one slice
per micro-batch with ``availableNow`` and returns the materialised result as a batch DataFrame.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from sitelens.operators import fetch as FT
from sitelens.operators import keywords as K
from sitelens.plans import sqlparts as S
from sitelens.plans.compose import fetches_from_events
from sitelens.plans.fetch_plans import FETCH_CTE, UPSERT_SQL
from sitelens.plans.registry import register
from sitelens.sinks.writers import scratch_path
from sitelens.sources.pages import ROWS_A_TASK, read_table
from sitelens.session import session_conf
from sitelens.streaming import incremental as ST

# State partitions for these small checkpoints (fixed when a checkpoint is created;
# size it to the state volume on a cluster).
STATE_CONF = {"spark.sql.shuffle.partitions": "8"}

N_FILES = 4
EVENTS_A_FILE = 1 << 18


def _slices(rows, key: str, path: str, each: int) -> int:
    """Write ``rows`` as N_FILES arrival slices of files of about ``each`` rows, and return the files of a slice: a task reads a
    file, so a slice of one file would be the work of one task, however many rows arrive."""
    files = max(1, -(-rows.count() // (N_FILES * each)))
    rows.repartitionByRange(N_FILES * files, key).write.mode("overwrite").parquet(path)
    return files


def _arrivals(spark, sf_dir):
    """All events in arrival slices, and the files of a slice."""
    e = read_table(spark, sf_dir, "events")
    path = scratch_path(spark, "events-arrivals")
    return path, e.schema, _slices(e, "event_id", path, EVENTS_A_FILE)


@register("stream_dedupe", f"WITH {FETCH_CTE} SELECT DISTINCT url FROM f")
def stream_dedupe(spark, sf_dir):
    """Every URL processed at most once as fetch records stream in."""
    src, schema, files = _arrivals(spark, sf_dir)
    out, ck = scratch_path(spark, "dedupe-out"), scratch_path(spark, "dedupe-ck")
    with session_conf(spark, STATE_CONF):
        ST.dedupe_stream(fetches_from_events(ST.file_stream(spark, src, schema, files)), out, ck)
    return spark.read.parquet(out).select("url")


@register(
    "stream_counts",
    f"WITH {FETCH_CTE} SELECT site, status_code, count(*) AS n FROM f WHERE error_type IS NULL GROUP BY ALL",
)
def stream_counts(spark, sf_dir):
    """Running status-code histogram per site."""
    src, schema, files = _arrivals(spark, sf_dir)
    out, ck = scratch_path(spark, "counts-out"), scratch_path(spark, "counts-ck")
    recs = FT.ok_rows(fetches_from_events(ST.file_stream(spark, src, schema, files)))
    with session_conf(spark, STATE_CONF):
        return ST.counts_stream(recs, ["site", "status_code"], out, ck).current()


@register("stream_upsert", UPSERT_SQL)
def stream_upsert(spark, sf_dir):
    """X3 + S8: urls table kept current per micro-batch (last write wins)."""
    src, schema, files = _arrivals(spark, sf_dir)
    out, ck = scratch_path(spark, "upsert-out"), scratch_path(spark, "upsert-ck")
    recs = fetches_from_events(ST.file_stream(spark, src, schema, files)).select("url", "event_id", "status_code", "ts", "content_type", "error_type")
    with session_conf(spark, STATE_CONF):
        urls = ST.upsert_stream(recs, out, ck, prepare=ST.html_latest)
    return urls.current().select("url", "event_id", "status_code", "ts")


PROGRESS_SQL = f"""
WITH {FETCH_CTE}, s AS (SELECT *, event_id % {N_FILES} AS slice FROM f),
first AS (SELECT url, min(slice) AS slice FROM s GROUP BY url)
SELECT slice, count(*) AS rows, count(DISTINCT url) AS keys, (SELECT count(*) FROM first WHERE first.slice = s.slice) AS new_urls FROM s GROUP BY slice
"""


@register("stream_progress", PROGRESS_SQL)
def stream_progress(spark, sf_dir):
    """One progress row per micro-batch, with the URLs that no earlier batch had. Arrival slices are fixed by the event
    id, one folder and so one stream step each."""
    e = read_table(spark, sf_dir, "events")
    src = scratch_path(spark, "progress-src")
    out, ck = scratch_path(spark, "progress-out"), scratch_path(spark, "progress-ck")
    for k in range(N_FILES):
        e.where(F.col("event_id") % N_FILES == k).write.mode("append").parquet(os.path.join(src, f"slice={k}"))
        with session_conf(spark, STATE_CONF):
            progress = ST.progress_stream(fetches_from_events(ST.file_stream(spark, src, e.schema)), out, ck)
    return progress.current().select(F.col("batch_id").alias("slice"), "rows", "keys", "new_urls")


@register("stream_resume", f"WITH {FETCH_CTE} SELECT DISTINCT url FROM f")
def stream_resume(spark, sf_dir):
    """Stop after half the files, add the rest, restart on the same
    checkpoint: every URL is emitted exactly once overall."""
    e = read_table(spark, sf_dir, "events")
    src = scratch_path(spark, "resume-src")
    out, ck = scratch_path(spark, "resume-out"), scratch_path(spark, "resume-ck")
    cut = e.agg(F.percentile_approx("event_id", 0.5)).first()[0]  # one scalar
    e.where(F.col("event_id") <= cut).write.mode("append").parquet(os.path.join(src, "part=1"))
    with session_conf(spark, STATE_CONF):
        ST.dedupe_stream(fetches_from_events(ST.file_stream(spark, src, e.schema, 8)), out, ck)
    e.where(F.col("event_id") > cut).write.mode("append").parquet(os.path.join(src, "part=2"))
    with session_conf(spark, STATE_CONF):
        ST.dedupe_stream(fetches_from_events(ST.file_stream(spark, src, e.schema, 8)), out, ck)
    return spark.read.parquet(out).select("url")


def _page_arrivals(spark, sf_dir):
    """The page store in arrival slices, and the files of a slice."""
    p = read_table(spark, sf_dir, "pages")
    path = scratch_path(spark, "pages-arrivals")
    return path, p.schema, _slices(p, "page_id", path, ROWS_A_TASK)


STREAM_KW_SQL = f"""
WITH {S.pages_cte()}, {S.kw_tokens_cte()}
SELECT site, keyword, count(*) AS frequency FROM kw GROUP BY site, keyword
"""


@register("stream_keyword_counts", STREAM_KW_SQL)
def stream_keyword_counts(spark, sf_dir):
    """X2 on pages: running per-site keyword counts as pages arrive."""
    from sitelens.functions.urls import site_of

    src, schema, files = _page_arrivals(spark, sf_dir)
    out, ck = scratch_path(spark, "kwstream-out"), scratch_path(spark, "kwstream-ck")
    pages = ST.file_stream(spark, src, schema, files).withColumn("site", site_of(F.col("url")))
    toks = K.page_tokens(pages).select("site", "keyword")
    with session_conf(spark, STATE_CONF):
        return ST.counts_stream(toks, ["site", "keyword"], out, ck).current().withColumnRenamed("n", "frequency")


TYPE_ERR_SQL = f"""
WITH {FETCH_CTE}
SELECT site, CASE WHEN error_type IS NULL THEN split_part(content_type, ';', 1) END AS content_type, error_type, count(*) AS n
FROM f GROUP BY ALL
"""


@register("stream_type_error_counts", TYPE_ERR_SQL)
def stream_type_error_counts(spark, sf_dir):
    """Running content-type and error-type counters per site."""
    src, schema, files = _arrivals(spark, sf_dir)
    out, ck = scratch_path(spark, "typeerr-out"), scratch_path(spark, "typeerr-ck")
    recs = fetches_from_events(ST.file_stream(spark, src, schema, files)).select(
        "site", F.when(F.col("error_type").isNull(), FT.content_type_base(F.col("content_type"))).alias("content_type"), "error_type"
    )
    with session_conf(spark, STATE_CONF):
        return ST.counts_stream(recs, ["site", "content_type", "error_type"], out, ck).current()


EXPIRY_SQL = f"""
WITH {FETCH_CTE}, day AS (SELECT DISTINCT url, ts::DATE AS day FROM f)
SELECT url, day FROM day
"""


@register("stream_dedupe_daily", EXPIRY_SQL)
def stream_dedupe_daily(spark, sf_dir):
    """X1 with expiry: each URL once a day. Records arrive day by day; the key holds the day, and the state drops the
    keys of days that the watermark has passed, so it stays as large as a few days' URLs."""
    recs = fetches_from_events(read_table(spark, sf_dir, "events")).select("url", F.col("ts").cast("timestamp").alias("at"))
    recs = recs.withColumn("day", F.to_date("at"))
    src = scratch_path(spark, "daily-src")
    # one file an arrival slice of some days, in the order of time
    recs.repartitionByRange(N_FILES, "day").sortWithinPartitions("at").write.parquet(src)
    out, ck = scratch_path(spark, "daily-out"), scratch_path(spark, "daily-ck")
    stream = ST.file_stream(spark, src, recs.schema, 1).withColumn("daily", F.struct("url", "day"))
    with session_conf(spark, STATE_CONF):
        ST.dedupe_stream(stream, out, ck, key="daily", watermark=("at", "31 days"))
    return spark.read.parquet(out).select("url", "day")


QUEUE_SQL = f"""
WITH {S.pages_cte()}
SELECT site AS domain, count(*) AS pages, 'completed' AS status, 1::BIGINT AS attempts FROM pg GROUP BY site
"""


@register("queue_resumed", QUEUE_SQL)
def queue_resumed(spark, sf_dir):
    """A queue of all sites, processed some domains at a time. The run breaks off half-way, and a second one goes on from the
    ledger: together they do what one run does, each domain once."""
    from sitelens.sources.pages import load_pages
    from sitelens.sources.queue import number_rows
    from sitelens.streaming import queue_run as QR

    pages = load_pages(spark, sf_dir).select("site", "url")
    queue = number_rows(pages.select(F.col("site").alias("domain")).distinct(), ["domain"])
    half = queue.count() // 2
    path = scratch_path(spark, "queue-run")
    tries = []

    def crawl(domains):
        tries.append(domains.count())
        if sum(tries) > half and len(tries) < 100:
            tries.extend([0] * 100)
            raise ConnectionError("the run breaks off")
        return pages.join(domains, F.col("site") == F.col("domain")).select("domain", "url")

    try:
        QR.process_queue(queue, crawl, path, per_step=max(half // 2, 1))
    except ConnectionError:
        pass
    run = QR.process_queue(queue, crawl, path, per_step=max(half // 2, 1))
    found = run.results(spark.createDataFrame([], "domain string, url string").schema).groupBy("domain").agg(F.count("*").alias("pages"))
    return run.ledger().groupBy("domain", "status").agg(F.count("*").alias("attempts")).join(found, "domain").select("domain", "pages", "status", "attempts")
