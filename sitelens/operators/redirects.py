"""Where redirects lead (F9, D1): the end of every chain by pointer jumping.

Each URL that redirects points to the next one. A round joins the pointers with themselves, so each then skips twice
as many hops: a chain of n hops takes log2(n) joins, whatever the number of chains. A URL whose chain has
not ended after as many rounds as the number of redirecting URLs allows runs in a loop.

Pointers compress to a small part of their size in memory, so a join by the size of their files would send each round's
table through the driver. The joins are by sorted shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.session import written


def next_hops(fetches: DataFrame) -> DataFrame:
    """(src, dst) of a fetch log: a fetch's redirects are visited in order and lead to its url. Where fetches
    disagree, the latest decides."""
    chain = F.concat("redirects", F.array("url"))
    hops = fetches.where(F.size("redirects") > 0).select(
        "ts", "event_id", F.explode(F.arrays_zip(F.slice(chain, 1, F.size(chain) - 1).alias("src"), F.slice(chain, 2, F.size(chain)).alias("dst"))).alias("h")
    )
    latest = hops.groupBy("h.src").agg(F.max_by(F.col("h.dst"), F.struct("ts", "event_id", "h.dst")).alias("dst"))
    return latest.where("src <> dst")


def final_targets(hops: DataFrame) -> DataFrame:
    """(url, final, hops, loop) of every URL that redirects. ``hops`` (src, dst): one next URL a source.

    For a URL that runs into a loop ``final`` is null and ``hops`` counts nothing: both are unknown."""
    now = written(hops.select("src", "dst", F.lit(1).cast("long").alias("n")), "hops")
    longest = now.count()  # no chain without a loop is longer
    done = 1
    while done < longest:
        ahead = now.select(F.col("src").alias("_at"), F.col("dst").alias("_to"), F.col("n").alias("_n"))
        joined = now.join(ahead.hint("merge"), F.col("dst") == F.col("_at"), "left")
        jumped = written(joined.select("src", F.coalesce("_to", "dst").alias("dst"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"), F.col("_at").isNotNull().alias("moved")), "hops")
        done *= 2
        now = jumped.drop("moved")
        if jumped.where("moved").limit(1).count() == 0:
            break
    # a pointer that still stands on a redirecting URL never ends
    ends = now.join(hops.select(F.col("src").alias("_at")).hint("merge"), F.col("dst") == F.col("_at"), "left")
    loop = F.col("_at").isNotNull()
    return ends.select(
        F.col("src").alias("url"), F.when(~loop, F.col("dst")).alias("final"), F.when(~loop, F.col("n")).alias("hops"), loop.alias("loop")
    )


def targets_with_status(targets: DataFrame, latest: DataFrame) -> DataFrame:
    """``targets`` with what the final URL's latest fetch in ``latest(url, status_code, error_type)`` says."""
    fetched = latest.select(F.col("url").alias("_url"), F.col("status_code").alias("final_status"), F.col("error_type").alias("final_error"))
    return targets.join(fetched.hint("merge"), F.col("final") == F.col("_url"), "left").drop("_url")
