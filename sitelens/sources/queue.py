"""Domain queue source (S2) and queue operations.

A queue is ``(pos, domain)``; ``pos`` orders it. Loading a text queue keeps
file order with (part file, position in file) and numbers lines by a distributed
prefix count, never in a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelens.session import written

QUEUE_SCHEMA = "pos long, domain string"


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def number_rows(df: DataFrame, order_cols: list[str], start: int = 1, name: str = "pos") -> DataFrame:
    """Dense global ordinals in ``order_cols`` order (any order without columns), in the JVM: the
    sorted rows are written with their place in their partition, and the partitions'
    sizes (one row a partition) give each its offset."""
    cols = [c for c in df.columns if c != name]
    ordered = df.select(*cols).orderBy(*order_cols) if order_cols else df.select(*cols)
    held = written(ordered.withColumn("_m", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_m", 33)
    sizes = held.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(F.col("_part").alias("_of"), F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = held.join(F.broadcast(offsets), part == F.col("_of"))  # one row a partition
    return numbered.select((place + F.col("_before") + F.lit(start)).cast("long").alias(name), *cols)


def load_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, value): the lines of a text folder in the order of its part files."""
    lines = spark.read.text(path).select(F.input_file_name().alias("_f"), F.monotonically_increasing_id().alias("_m"), "value")
    return number_rows(lines, ["_f", "_m"]).select("pos", "value")


def load_queue(spark: SparkSession, path: str) -> DataFrame:
    """One domain per line, trimmed; blank and '#' lines dropped; a missing
    file is an empty queue."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], QUEUE_SCHEMA)
    lines = spark.read.text(path).select(
        F.input_file_name().alias("_f"), F.monotonically_increasing_id().alias("_m"), F.trim("value").alias("domain")
    )
    kept = lines.where((F.col("domain") != "") & ~F.col("domain").startswith("#"))
    return number_rows(kept, ["_f", "_m"]).select("pos", "domain")


def add_to_queue(queue: DataFrame, new_domains: DataFrame) -> DataFrame:
    """Append trimmed, non-empty domains not yet queued, first occurrence
    of in-list duplicates only, in the order given (``new_domains(pos, domain)``)."""
    cand = new_domains.select(F.col("pos").alias("npos"), F.trim("domain").alias("domain")).where(F.col("domain") != "")
    first = cand.groupBy("domain").agg(F.min("npos").alias("npos"))
    fresh = first.join(queue.select("domain"), "domain", "left_anti")
    top = queue.agg(F.coalesce(F.max("pos"), F.lit(0))).first()[0]  # one scalar
    ranked = number_rows(fresh, ["npos"], start=int(top) + 1)
    return queue.select("pos", "domain").unionByName(ranked.select("pos", "domain"))


def remaining(queue: DataFrame, completed: DataFrame) -> DataFrame:
    """Queue − completed, order kept."""
    return queue.join(completed.select("domain"), "domain", "left_anti").select("pos", "domain")


def listing(queue: DataFrame) -> DataFrame:
    """1-based ordinal per queued domain."""
    return number_rows(queue.select("pos", "domain").withColumnRenamed("pos", "_p"), ["_p"], name="ordinal").select("ordinal", "domain")


def batch_rollup(outcomes: DataFrame, queue: DataFrame | None = None) -> DataFrame:
    """A19 over ``outcomes(domain, seconds, success)``: completed/failed counts
    and seconds statistics of completed domains; with the queue also how many
    of its domains remain (those not completed)."""
    ok = F.col("success")
    row = outcomes.agg(
        F.count_if(ok).alias("completed"),
        F.count_if(~ok).alias("failed"),
        F.avg(F.when(ok, F.col("seconds"))).alias("avg_seconds"),
        F.min(F.when(ok, F.col("seconds"))).alias("min_seconds"),
        F.max(F.when(ok, F.col("seconds"))).alias("max_seconds"),
    )
    if queue is None:
        return row
    left = remaining(queue, outcomes.where("success")).agg(F.count("*").alias("remaining"))
    return row.join(left)  # one row each


def slowest(outcomes: DataFrame, k: int = 5, min_completed: int = 6) -> DataFrame:
    """The k slowest completed domains, only when more than five completed. The ``k`` and
    ``min_completed`` longest are enough to tell, so nothing is counted beforehand."""
    top = outcomes.where("success").orderBy(F.col("seconds").desc(), F.col("domain")).limit(max(k, min_completed))
    ranked = top.withColumns({
        "_r": F.row_number().over(Window.orderBy(F.col("seconds").desc(), F.col("domain"))),
        "_n": F.count("*").over(Window.partitionBy(F.lit(1))),
    })
    return ranked.where((F.col("_r") <= k) & (F.col("_n") >= min_completed)).select("domain", "seconds")
