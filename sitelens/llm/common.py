"""Helpers shared by the operators: shared scratch tables, checked broadcasts, column forms."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.session import ensure_checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def prepare(spark: SparkSession) -> None:
    """Session settings the Python stages rely on: whole texts travel in Arrow batches,
    so a batch holds few rows and a worker's memory stays bounded by a few long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    ensure_checkpoint_dir(spark)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(posixpath.join(sf_dir, f"{name}.parquet"))


def store(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back.

    Cuts the lineage with files that every executor can reach, so a lost executor
    costs a re-read and never a recomputation from the start."""
    spark = df.sparkSession
    path = posixpath.join(ensure_checkpoint_dir(spark), f"sitelens-{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_within(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint only when the counted rows are within ``max_rows``; otherwise the
    frame is returned as it is and the join shuffles. Callers pass narrow frames, so the
    row bound is a byte bound. Both ways give the same rows."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only (``lower`` would also fold other alphabets)."""
    return F.translate(col, UPPER, LOWER)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True where crc32 of the id's text is 0 modulo ``folds``; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def label_of(labels: DataFrame, key: str, col: str) -> DataFrame:
    """One 0/1 label per key. Null keys, null labels and keys whose repeated rows disagree
    are left out (they teach nothing)."""
    return (
        labels.select(F.col(key).alias("label_key"), F.col(col).cast("int").alias("label"))
        .filter("label_key IS NOT NULL AND label IN (0, 1)")
        .groupBy("label_key")
        .agg(F.min("label").alias("label"), F.max("label").alias("label_max"))
        .filter("label = label_max")
        .drop("label_max")
    )


def label_sample(labels: DataFrame, key: str, col: str, max_rows: int) -> DataFrame:
    """At most ``max_rows`` training labels (label_key, label, h) outside the held-out fold: those whose
    hash ``h`` lies below a bound that their counted number sets, so nothing is sorted or
    gathered to choose them, and the same labels are chosen in any partitioning."""
    known = label_of(labels, key, col).filter(~held_out(F.col("label_key")))
    known = known.withColumn("h", F.pmod(F.xxhash64(F.col("label_key").cast("string"), F.lit(max_rows)), F.lit(1 << 40)))
    n = known.count()
    if n > max_rows:
        known = known.filter(F.col("h") < int((1 << 40) * max_rows / n))
    return known.orderBy("h", "label_key").limit(max_rows)


def byte_level() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 bytes stand for
    themselves, the others for the code points from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
