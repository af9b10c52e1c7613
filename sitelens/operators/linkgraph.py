"""Link checks over resolved links: broken and missing targets (D1), degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def broken_links(links: DataFrame, latest: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """``links(source, target)`` whose target's latest fetch failed or has an error status, or that
    was never fetched. Links are reduced to distinct pairs before the join.

    With ``targets`` (``redirects.final_targets``) a link is judged by where its redirects end, in
    ``final`` after ``hops``; one that never ends is broken by its ``loop``."""
    pairs = links.select("source", "target").distinct()
    if targets is None:
        pairs = pairs.withColumns({"final": F.col("target"), "hops": F.lit(0).cast("long"), "_loop": F.lit(False)})
    else:
        ends = targets.select(F.col("url").alias("_from"), "final", "hops", F.col("loop").alias("_loop"))
        joined = pairs.join(ends, F.col("target") == F.col("_from"), "left")
        direct = F.col("_from").isNull()
        pairs = joined.select(
            "source", "target", F.when(direct, F.col("target")).otherwise(F.col("final")).alias("final"),
            F.when(direct, F.lit(0).cast("long")).otherwise(F.col("hops")).alias("hops"), F.coalesce("_loop", F.lit(False)).alias("_loop"),
        )
    fetched = latest.select(F.col("url").alias("_url"), "status_code", "error_type")
    joined = pairs.join(fetched, F.col("final") == F.col("_url"), "left")
    reason = (
        F.when(F.col("_loop"), F.lit("loop"))
        .when(F.col("_url").isNull(), F.lit("missing"))
        .when(F.col("error_type").isNotNull(), F.lit("error"))
        .when(F.col("status_code") >= 400, F.lit("status"))
    )
    return joined.withColumn("reason", reason).where(F.col("reason").isNotNull()).drop("_url", "_loop")


def degrees(endpoints: DataFrame) -> DataFrame:
    """In- and out-degree of every URL that links or is linked in ``endpoints(url, endpoint)`` (distinct per page).
    One aggregation over both ends, so a hub is summed map-side."""
    ends = endpoints.select(
        F.explode(F.array(
            F.struct(F.col("endpoint").alias("url"), F.lit(1).alias("i"), F.lit(0).alias("o")),
            F.struct(F.col("url").alias("url"), F.lit(0).alias("i"), F.lit(1).alias("o")),
        )).alias("e")
    )
    return ends.groupBy("e.url").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))
