"""Merging successive runs (U2–U9), keyed writes (S8, S9) and snapshot diffs.

A run is a set of per-site tables (keywords, sets, url details, forms, files,
statistics). Every merge is a union/join keyed by site (and the item key), so
runs of any size merge without collecting anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union_sets(old: DataFrame, new: DataFrame, value: str, new_cap: int | None = None) -> DataFrame:
    """Union-distinct of a per-site set. With ``new_cap`` the new side keeps
    only its first ``new_cap`` values in sort order (the endpoint list cap)."""
    n = new.select("site", value)
    if new_cap is not None:
        w = Window.partitionBy("site").orderBy(value)
        n = n.distinct().withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= new_cap).drop("_r")
    return old.select("site", value).unionByName(n).distinct()


def add_keywords(old_top: DataFrame, new_counts: DataFrame, k: int = 100) -> DataFrame:
    """Old top-k counts plus the new run's full counts, re-ranked to top-k."""
    summed = old_top.select("site", "keyword", "frequency").unionByName(new_counts.select("site", "keyword", "frequency"))
    summed = summed.groupBy("site", "keyword").agg(F.sum("frequency").alias("frequency"))
    w = Window.partitionBy("site").orderBy(F.col("frequency").desc(), F.col("keyword"))
    return summed.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def overwrite_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keyed overwrite, the new run wins for every key it has."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def append_runs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Forms are appended (duplicates kept)."""
    return old.unionByName(new, allowMissingColumns=True)


def add_counts(old: DataFrame, new: DataFrame, keys: list[str], value: str = "n") -> DataFrame:
    """U8: histogram counts added key by key."""
    return old.select(*keys, value).unionByName(new.select(*keys, value)).groupBy(*keys).agg(F.sum(value).alias(value))


# ---- U3, T2 across runs: heavy-hitter summaries --------------------------------------

def keyword_summary(counts: DataFrame, size: int = 1000) -> DataFrame:
    """A mergeable summary of a run's ``counts(site, keyword, frequency)``: the ``size`` most frequent keywords of a
    site, (site, keyword, low, high), and a row of keyword NULL whose ``high`` bounds every keyword that is left out."""
    w = Window.partitionBy("site").orderBy(F.col("frequency").desc(), F.col("keyword"))
    first = counts.select("site", "keyword", "frequency", F.row_number().over(w).alias("_r")).where(F.col("_r") <= size + 1)
    kept = first.where(F.col("_r") <= size).select("site", "keyword", F.col("frequency").alias("low"), F.col("frequency").alias("high"))
    floor = first.groupBy("site").agg(F.coalesce(F.max(F.when(F.col("_r") > size, F.col("frequency"))), F.lit(0)).alias("high"))
    return kept.unionByName(floor.select("site", F.lit(None).cast("string").alias("keyword"), F.lit(0).cast("long").alias("low"), F.col("high").cast("long").alias("high")))


def merge_summaries(*runs: DataFrame, size: int = 1000) -> DataFrame:
    """One summary of several. A keyword's true count lies between ``low``, what the runs that hold it know, and ``high``,
    which adds what the others may have left out."""
    both = runs[0].withColumn("_run", F.lit(0))
    for i, run in enumerate(runs[1:], 1):
        both = both.unionByName(run.withColumn("_run", F.lit(i)))
    # one row a site and run
    floors = both.where("keyword IS NULL").groupBy("site").agg(
        F.sum("high").alias("_all"), F.map_from_entries(F.collect_list(F.struct("_run", "high"))).alias("_floor")
    )
    held = both.where("keyword IS NOT NULL").groupBy("site", "keyword").agg(
        F.sum("low").alias("low"), F.sum("high").alias("high"), F.collect_set("_run").alias("_in")
    )
    known = F.aggregate("_in", F.lit(0).cast("long"), lambda a, r: a + F.element_at("_floor", r))
    merged = held.join(floors, "site").select("site", "keyword", "low", (F.col("high") + F.col("_all") - known).alias("high"), "_all")
    w = Window.partitionBy("site").orderBy(F.col("low").desc(), F.col("high").desc(), F.col("keyword"))
    ranked = merged.withColumn("_r", F.row_number().over(w))
    kept = ranked.where(F.col("_r") <= size).select("site", "keyword", "low", "high")
    # what is cut off now, or was left out before, has at most this many
    cut = ranked.where(F.col("_r") > size).groupBy("site").agg(F.max("high").alias("_cut"))
    floor = floors.select("site", "_all").join(cut, "site", "left")
    floor = floor.select("site", F.lit(None).cast("string").alias("keyword"), F.lit(0).cast("long").alias("low"), F.greatest("_all", F.coalesce("_cut", F.lit(0))).alias("high"))
    return kept.unionByName(floor)


def top_of_summary(summary: DataFrame, k: int = 100) -> DataFrame:
    """(site, keyword, frequency, error, rank, certain): the top k by what is known. ``frequency`` is at most ``error`` too low, and
    a ``certain`` keyword belongs to the top k whatever was left out."""
    w = Window.partitionBy("site").orderBy(F.col("low").desc(), F.col("keyword"))
    named = summary.where("keyword IS NOT NULL").withColumn("rank", F.row_number().over(w))
    # the most that any other keyword can have
    rivals = named.where(F.col("rank") > k).select("site", "high").unionByName(summary.where("keyword IS NULL").select("site", "high"))
    rivals = rivals.groupBy("site").agg(F.max("high").alias("_rival"))
    top = named.where(F.col("rank") <= k).join(rivals, "site", "left")
    return top.select(
        "site", "keyword", F.col("low").alias("frequency"), (F.col("high") - F.col("low")).alias("error"), "rank",
        (F.col("low") >= F.coalesce("_rival", F.lit(0))).alias("certain"),
    )


# ---- U9, A3 across runs ---------------------------------------------------------------

AVERAGED = ("average_response_time", "average_page_size")
#: statistics that count distinct values: two runs' numbers do not tell how many they share
DISTINCT = (
    "total_urls_visited", "total_endpoints_found", "total_subdomains_found", "total_keywords", "unique_emails", "unique_phones", "api_endpoints",
)


def merge_facts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Page facts (site, url, kind, value, n) of two runs as one run over both would find them: a page of
    both runs counts as the new run saw it."""
    return overwrite_by_key(old, new, ["site", "url"])


def merge_statistics(
    old: DataFrame, new: DataFrame, mode: str = "compat", weight: str = "total_urls_visited", distinct: DataFrame | None = None
) -> DataFrame:
    """U9 over long-form statistics ``(site, stat, value)``.

    ``compat`` sums every numeric statistic — averages, minima and maxima
    included — as the original merge does. ``recompute`` gives what one run over both
    would, for runs that share no fetches: totals are summed, minima, maxima and the peak queue combined, and averages
    weighted by each run's ``weight`` statistic (NULL when a run that has the average lacks its weight). Distinct
    counts do not follow from two numbers: they come from ``distinct`` (site, stat, value), which merged facts
    (``stats.count_facts``) or sketches (``stats.count_sketches``) give, and are NULL without it; only the
    weight, a count of fetches, is summed then.
    """
    both = old.select("site", "stat", F.col("value").alias("old")).join(
        new.select("site", "stat", F.col("value").alias("new")), ["site", "stat"], "full"
    )
    o, n = F.coalesce(F.col("old"), F.lit(0.0)), F.coalesce(F.col("new"), F.lit(0.0))
    if mode == "compat":
        return both.select("site", "stat", (o + n).alias("value"))
    pages = lambda run, name: run.where(F.col("stat") == weight).select("site", F.col("value").alias(name))
    both = both.join(pages(old, "old_n"), "site", "left").join(pages(new, "new_n"), "site", "left")
    wo, wn = F.when(F.col("old").isNotNull(), F.col("old_n")).otherwise(0.0), F.when(F.col("new").isNotNull(), F.col("new_n")).otherwise(0.0)
    val = (
        F.when(F.col("stat").startswith("min_"), F.least("old", "new"))
        .when(F.col("stat").startswith("max_") | (F.col("stat") == "peak_queue_size"), F.greatest("old", "new"))
        .when(F.col("stat").isin(*AVERAGED), F.try_divide(o * wo + n * wn, wo + wn))
        .when(F.col("stat").isin(*[d for d in DISTINCT if d != weight]), F.lit(None).cast("double"))
        .otherwise(o + n)
    )
    merged = both.select("site", "stat", val.alias("value"))
    if distinct is None:
        return merged
    counted = distinct.select("site", "stat", F.col("value").cast("double").alias("_counted"))
    joined = merged.join(counted, ["site", "stat"], "full")
    return joined.select("site", "stat", F.coalesce("_counted", "value").alias("value"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "url", content: str = "html") -> DataFrame:
    """Added / removed / changed / unchanged per key by content hash."""
    o = old.select(key, F.sha2(F.col(content), 256).alias("old_hash"))
    n = new.select(key, F.sha2(F.col(content), 256).alias("new_hash"))
    j = o.join(n, key, "full")
    status = (
        F.when(F.col("old_hash").isNull(), F.lit("added"))
        .when(F.col("new_hash").isNull(), F.lit("removed"))
        .when(F.col("old_hash") != F.col("new_hash"), F.lit("changed"))
        .otherwise(F.lit("unchanged"))
    )
    return j.select(key, status.alias("status"))


def latest_wins(df: DataFrame, key: str, order_cols: list[str]) -> DataFrame:
    """S8 as an aggregate: last write per key by ``order_cols`` (map-side partial)."""
    cols = [c for c in df.columns if c != key]
    latest = df.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order_cols)).alias("_r"))
    return latest.select(key, "_r.*")


def latest_rows(df: DataFrame, keys: list[str], order_cols: list[str]) -> DataFrame:
    """``latest_wins`` for keys of several columns."""
    cols = [c for c in df.columns if c not in keys]
    latest = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order_cols)).alias("_r"))
    return latest.select(*keys, "_r.*")
