"""Structured Streaming versions of the crawl's continuous behaviour.

Pages or fetch records arrive as files; each query runs with
``trigger(availableNow=True)`` and a checkpoint location, so it processes what
is there, stops, and resumes exactly where it left off on the next run.

* X1 ``dedupe_stream``    – at-most-once per URL: ``dropDuplicates`` on the URL (state grows like the visited
  set), or with a watermark ``dropDuplicatesWithinWatermark``, whose state holds the keys of that time only.
  State lives in RocksDB with changelog checkpoints, so a batch saves what it changed and not all keys.
* X2 ``counts_stream``    – running histograms (status codes) in update mode; a batch replaces its
  changed counts in a keyed table.
* X3 ``upsert_stream``    – keyed last-write-wins replace of the ``urls`` table, bucket by bucket.
* X4 ``progress_stream``  – one progress row per micro-batch: rows, keys and URLs never seen before.
* X5 resume              – rerunning a query on the same checkpoint picks up
  only new files. Queues resume by their ledger (``queue_run``).

Keyed tables (``sinks.keyed``) take a batch by its number: a retried batch replaces what its first try wrote.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.operators import fetch as FT
from sitelens.operators import merge as M
from sitelens.session import session_conf, written
from sitelens.sinks.keyed import KeyedTable, overwrite_keys, replace_by_key

#: state store of every stateful query here; fixed when a checkpoint is created
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Files as they arrive; ``files_per_batch`` slices them into micro-batches (no limit by default)."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def run_available(spark: SparkSession, writer, checkpoint: str) -> list[dict]:
    """Run what has arrived to its end. Returns (batch_id, rows, state_rows) of each micro-batch: ``state_rows`` is what the
    stateful operators hold after it."""
    with session_conf(spark, STATE_STORE):
        q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    if q.exception() is not None:  # pragma: no cover
        raise q.exception()
    return [
        {"batch_id": p["batchId"], "rows": p["numInputRows"], "state_rows": sum(o["numRowsTotal"] for o in p["stateOperators"])}
        for p in q.recentProgress
    ]


def dedupe_stream(records: DataFrame, out: str, checkpoint: str, key: str = "url",
                  watermark: tuple[str, str] | None = None) -> list[dict]:
    """The first record of each key is emitted, whole. With a ``watermark`` (time column, delay) a key is forgotten once
    the watermark has passed its time, so the state holds the keys of that span and not of all time."""
    if watermark is not None:
        records = records.withWatermark(*watermark).dropDuplicatesWithinWatermark([key])
    else:
        records = records.dropDuplicates([key])
    return run_available(records.sparkSession, records.writeStream.format("parquet").option("path", out).outputMode("append"), checkpoint)


def counts_stream(records: DataFrame, keys: list[str], out: str, checkpoint: str, buckets: int = 16) -> KeyedTable:
    """Running counts. Each micro-batch replaces the counts that changed (update mode) in a keyed table."""
    counts = records.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    table = KeyedTable(records.sparkSession, out, counts.schema, keys, buckets)
    sink = lambda batch, number: table.put(batch, number, _null_safe(keys))
    run_available(records.sparkSession, counts.writeStream.outputMode("update").foreachBatch(sink), checkpoint)
    return table


def _null_safe(keys: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Counts of keys with null parts: the larger count is the later one."""
    return lambda held, rows: held.unionByName(rows).groupBy(*keys).agg(F.max("n").alias("n"))


def upsert_stream(records: DataFrame, out: str, checkpoint: str, key: str = "url", order_cols=("ts", "event_id"),
                  prepare: Callable[[DataFrame], DataFrame] | None = None, buckets: int = 16) -> KeyedTable:
    """Keyed replace, last write wins. A micro-batch reduces to its latest row per key and is merged into
    the buckets that it touches."""
    order = list(order_cols)
    table = KeyedTable(records.sparkSession, out, records.schema, [key], buckets)

    def sink(batch: DataFrame, number: int) -> None:
        table.put(M.latest_wins(prepare(batch) if prepare is not None else batch, key, order), number, replace_by_key([key], order))

    run_available(records.sparkSession, records.writeStream.foreachBatch(sink), checkpoint)
    return table


def progress_stream(records: DataFrame, out: str, checkpoint: str, key: str = "url", buckets: int = 16) -> KeyedTable:
    """(batch_id, rows, keys, new_urls) of each micro-batch. New keys are those that no earlier batch stored; they are written
    to the visited table. A retried batch counts and writes the same again."""
    spark = records.sparkSession
    visited = KeyedTable(spark, os.path.join(out, "visited"), f"{key} string", [key], buckets)
    progress = KeyedTable(spark, os.path.join(out, "progress"), "batch_id long, rows long, keys long, new_urls long", ["batch_id"], 1)

    def sink(batch: DataFrame, number: int) -> None:
        # the batch is read once; what is counted afterwards are its distinct keys
        keys = written(batch.groupBy(key).agg(F.count(F.lit(1)).alias("n")), "batch-keys")
        _, held = visited.touched(keys, number)
        known = held.select(F.col(key).alias("_held"))
        marked = written(keys.join(known, F.col(key).eqNullSafe(F.col("_held")), "left").select(key, "n", F.col("_held").isNull().alias("new")), "batch-new")
        made = marked.agg(
            F.lit(number).cast("long").alias("batch_id"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("keys"),
            F.count_if("new").alias("new_urls"),
        )
        visited.put(marked.where("new").select(key), number, lambda held, those: held.unionByName(those))
        progress.put(made, number, overwrite_keys(["batch_id"]))

    run_available(spark, records.writeStream.foreachBatch(sink), checkpoint)
    return progress


def html_latest(batch: DataFrame) -> DataFrame:
    """Batch-side filter for the urls table: successful HTML fetches only."""
    return batch.where(FT.is_html(F.col("content_type")) & F.col("error_type").isNull())
