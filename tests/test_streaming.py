"""Streaming operators on the event log arriving as files."""

import pytest
from pyspark.sql import functions as F

from sitelens.plans.compose import fetches_from_events
from sitelens.sinks.keyed import KeyedTable, replace_by_key
from sitelens.sinks.writers import scratch_path
from sitelens.streaming import incremental as ST

SF = "/root/testdata/sf0.001"


def _arrivals(spark):
    e = spark.read.parquet(f"{SF}/events.parquet")
    path = scratch_path(spark, "t-events")
    e.repartitionByRange(3, "event_id").write.mode("overwrite").parquet(path)
    return e, path


def test_dedupe_without_watermark_is_exactly_distinct(spark):
    e, src = _arrivals(spark)
    out, ck = scratch_path(spark, "t-out"), scratch_path(spark, "t-ck")
    ST.dedupe_stream(fetches_from_events(ST.file_stream(spark, src, e.schema, 1)), out, ck)
    whole = spark.read.parquet(out)
    assert {"url", "status_code", "ts"} <= set(whole.columns)  # the whole record is kept
    got = whole.select("url")
    assert got.count() == got.distinct().count() == fetches_from_events(e).select("url").distinct().count()


def test_dedupe_within_watermark_bounds_state(spark):
    e, src = _arrivals(spark)
    out, ck = scratch_path(spark, "t-wout"), scratch_path(spark, "t-wck")
    recs = fetches_from_events(ST.file_stream(spark, src, e.schema, 1)).withColumn("ts", F.col("ts").cast("timestamp"))
    ST.dedupe_stream(recs, out, ck, watermark=("ts", "1 hour"))
    n = spark.read.parquet(out).count()
    distinct = fetches_from_events(e).select("url").distinct().count()
    # A URL seen again after its watermark window may be emitted again.
    assert distinct <= n <= e.count()


def test_state_is_flat_under_expiry(spark):
    """Ten batches of new keys: without a watermark the state holds all, with one only the last hours'."""
    src = scratch_path(spark, "t-flat")
    for i in range(10):
        rows = spark.range(40).select(F.concat(F.lit(f"u{i}-"), F.col("id")).alias("url"), F.timestamp_seconds(F.lit(1_700_000_000 + 7200 * i)).alias("at"))
        rows.coalesce(1).write.mode("append").parquet(src)
    schema = "url string, at timestamp"
    outs = [scratch_path(spark, f"t-flat{i}") for i in range(2)]
    all_ = ST.dedupe_stream(ST.file_stream(spark, src, schema, 1), outs[0], scratch_path(spark, "t-flat-ck"))
    some = ST.dedupe_stream(ST.file_stream(spark, src, schema, 1), outs[1], scratch_path(spark, "t-flat-ck"), watermark=("at", "1 hour"))
    assert all_[-1]["state_rows"] == 400
    assert max(p["state_rows"] for p in some) <= 120 and some[-1]["state_rows"] <= 80
    assert [spark.read.parquet(o).count() for o in outs] == [400, 400]


def test_a_keyed_table_costs_one_version_of_each_bucket(spark):
    """Twenty batches: reads touch at most one folder a bucket; retries, vacuum and null keys change nothing."""
    path = scratch_path(spark, "t-keyed")
    table = KeyedTable(spark, path, "url string, n long", ["url"], buckets=4)
    merge = replace_by_key(["url"], ["n"])
    batch = lambda k: spark.createDataFrame([(f"u{i}", 100 * k + i) for i in range(k, k + 6)] + [(None, k)], "url string, n long")
    want = {}
    for k in range(8):
        table.put(batch(k), k, merge)
        want |= {r["url"]: r["n"] for r in batch(k).collect()}
    rows = lambda: {r["url"]: r["n"] for r in table.current().collect()}
    assert rows() == want and table.current().count() == len(want)
    assert len({f.rsplit("/", 1)[0] for f in table.current().inputFiles()}) <= 4
    table.put(batch(7), 7, merge)  # a retried batch
    assert rows() == want and table.current().count() == len(want)
    batch(8).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{path}/rows/n=8")  # a batch that broke off before its list
    assert rows() == want
    table.vacuum()
    assert rows() == want
    table.put(batch(8), 8, merge)
    assert rows() == want | {r["url"]: r["n"] for r in batch(8).collect()}
    assert KeyedTable(spark, scratch_path(spark, "t-none"), "url string", ["url"]).current().count() == 0


def test_a_retried_append_adds_no_row(spark):
    from sitelens.sinks.warehouse import write_rows

    path = scratch_path(spark, "t-append") + "/links"
    rows = lambda n: spark.range(n).select(F.concat(F.lit("s"), F.col("id") % 3).alias("site"), F.col("id").alias("v"))
    for run, n in ((1, 10), (2, 5), (2, 5), (1, 10)):
        write_rows(rows(n), path, run=run)
    back = spark.read.parquet(path)
    assert back.count() == 15 and back.select("id").distinct().count() == 15
    assert sorted(r["id"] for r in back.where("run = 2").collect()) == [11, 12, 13, 14, 15]


def test_a_queue_resumes_after_a_failure(spark):
    from sitelens.streaming.queue_run import process_queue

    queue = spark.createDataFrame([(i, f"d{i}") for i in range(7)], "pos long, domain string")
    path, asked = scratch_path(spark, "t-queue"), []

    def crawl(domains):
        names = sorted(r["domain"] for r in domains.collect())
        asked.append(names)
        if len(asked) == 2:
            raise OSError("lost")
        return domains.where("domain <> 'd4'").select("domain", F.concat("domain", F.lit("/")).alias("url"))

    with pytest.raises(OSError):
        process_queue(queue, crawl, path, per_step=3)
    run = process_queue(queue, crawl, path, per_step=3)
    assert asked == [["d0", "d1", "d2"], ["d3", "d4", "d5"], ["d3", "d4", "d5"], ["d6"]]
    status = {r["domain"]: (r["status"], r["pages"]) for r in run.ledger().collect()}
    assert status == {f"d{i}": ("completed", 1) for i in range(7)} | {"d4": ("failed", 0)}
    results = spark.createDataFrame([], "domain string, url string").schema
    assert sorted(r["domain"] for r in run.results(results).collect()) == [f"d{i}" for i in range(7) if i != 4]
    process_queue(queue, lambda d: d.select("domain", F.lit("x").alias("url")), path)  # only the failed one is left
    assert {r["domain"] for r in run.completed().collect()} == {f"d{i}" for i in range(7)}
    assert run.completed().count() == 7


def test_restart_resumes_from_checkpoint(spark):
    e, src = _arrivals(spark)
    out, ck = scratch_path(spark, "t-rout"), scratch_path(spark, "t-rck")
    stream = lambda: fetches_from_events(ST.file_stream(spark, src, e.schema, 1))
    ST.dedupe_stream(stream(), out, ck)
    first = spark.read.parquet(out).count()
    ST.dedupe_stream(stream(), out, ck)  # nothing new arrived: no new output
    assert spark.read.parquet(out).count() == first


def test_a_failed_batch_is_retried_in_place(spark):
    """The first try of a batch writes part of its rows and fails; the rerun leaves what a clean run leaves."""
    e, src = _arrivals(spark)
    stream = lambda: fetches_from_events(ST.file_stream(spark, src, e.schema, 1)).select("url", "event_id", "status_code", "ts")
    clean, ck = scratch_path(spark, "t-up"), scratch_path(spark, "t-upck")
    first = ST.upsert_stream(stream(), clean, ck)
    out, ck = scratch_path(spark, "t-up2"), scratch_path(spark, "t-upck2")
    tries = []

    def fails_once(batch):
        tries.append(1)
        if len(tries) == 2:
            batch.limit(3).withColumn("bucket", F.lit(0)).write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/rows/n=1")
            raise RuntimeError("lost")
        return batch

    with pytest.raises(Exception, match="lost"):
        ST.upsert_stream(stream(), out, ck, prepare=fails_once)
    again = ST.upsert_stream(stream(), out, ck, prepare=fails_once)
    table = lambda t: sorted(map(tuple, t.current().collect()))
    assert table(again) == table(first) and len(table(again)) > 10

    counts, ck = scratch_path(spark, "t-n"), scratch_path(spark, "t-nck")
    got = {r.status_code: r.n for r in ST.counts_stream(stream(), ["status_code"], counts, ck).current().collect()}
    want = {r.status_code: r["count"] for r in fetches_from_events(e).groupBy("status_code").count().collect()}
    assert got == want
