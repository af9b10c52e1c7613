"""URL filter by a Bloom filter cascade (operator 7).

DataFrame functions only. A rule is a host and the start of a path (``example.org/es/``). A url's keys are the
suffixes of its host joined to the starts of its path, at the label counts and lengths that listed rules
have. A cascade holds a list of keys exactly for every key of the corpus: level 1 encodes the
listed keys, level 2 the keys of the corpus that level 1 wrongly accepts, level 3 the listed keys
that level 2 wrongly accepts, and so on until a level errs on none. Membership is then one
expression over the levels' bits, evaluated in the url's own row: no join, and no error on the corpus
for which the cascade was built.

The filters grow with the list (``BITS`` bits a key) and not with the corpus; the collected bits are the
only thing that passes the driver. The keys of the corpus stay in a distributed table.

Cases: a null url, or one without ``://``, has empty host and path and no keys; repeated rows are judged each;
an empty list accepts nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import ascii_lower, broadcast_within, store

BITS, HASHES = 12, 6


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end; path: from there up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def keys_of(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """array<string>: host suffixes of the given label counts x path starts of the given lengths."""
    parts = F.split(host, r"\.")
    suffixes = F.array_compact(
        F.array(*(F.when(F.size(parts) >= n, F.array_join(F.slice(parts, -n, n), ".")) for n in labels))
    )
    starts = F.array_compact(F.array(*(F.when(F.length(path) >= n, F.left(path, F.lit(n))) for n in lengths)))
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.concat(s, p))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(pairs)


class Bloom:
    """Bits of one level; ``has`` tests a key inside its row."""

    def __init__(self, keys: DataFrame, level: int, n: int):
        self.level, self.size = level, 64 * max(-(-BITS * n // 64), 1)
        places = keys.select(F.explode(F.array(*map(self.place, range(HASHES), [F.col("key")] * HASHES))).alias("at"))
        words = places.groupBy(F.expr("at div 64").alias("word")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")
        )
        bits = [0] * (self.size // 64)
        for r in words.toLocalIterator():
            bits[r["word"]] = r["bits"]
        # one folded literal, however many words
        self.bits = F.from_json(F.lit(json.dumps(bits)), "array<bigint>")

    def place(self, i: int, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(self.level), F.lit(i)), F.lit(self.size).cast("long"))

    def has(self, key: Column) -> Column:
        out = F.lit(True)
        for i in range(HASHES):
            at = self.place(i, key)
            word = F.get(self.bits, F.floor(at / 64).cast("int"))
            out = out & (F.getbit(word, (at % 64).cast("int")) == 1)
        return out


def build(listed: DataFrame, universe: DataFrame) -> list[Bloom]:
    """Levels for the keys of ``listed`` (key) that are exact over ``universe`` (key, distinct)."""
    listed = store(listed.filter("key IS NOT NULL").select("key").distinct(), "listed")
    others = universe.join(broadcast_within(listed, 1_000_000), "key", "left_anti")
    levels: list[Bloom] = []
    encode, against = listed, others
    while n := encode.count():
        levels.append(Bloom(encode, len(levels) + 1, n))
        encode, against = store(against.filter(levels[-1].has(F.col("key"))), "false-positives"), encode
    return levels


def member(levels: list[Bloom], key: Column) -> Column:
    """Is a key of the universe listed? It passes a level and is not undone by the next."""
    out = F.lit(False)
    for level in reversed(levels):
        out = level.has(key) & ~out
    return out


def fitting(keys: Column, levels: list[Bloom], verdict: str) -> Column:
    """The keys that the cascade holds, as structs (n, key, verdict); the greatest is the longest."""
    return F.transform(
        F.filter(keys, lambda k: member(levels, k)),
        lambda k: F.struct(F.length(k).alias("n"), k.alias("key"), F.lit(verdict).alias("verdict")),
    )


def judge(pages: DataFrame, url: str, rules: list[tuple[str, str, str]] | DataFrame, default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict. ``rules``: (verdict, host, path) rows; the longest rule that
    fits decides (``block`` if a key is listed under both), ``default`` where none does."""
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(rules, "verdict string, host string, path string")
    rules = rules.select("verdict", ascii_lower(F.col("host")).alias("host"), F.col("path"))
    shape = rules.agg(
        F.sort_array(F.collect_set(F.size(F.split("host", r"\.")))).alias("labels"),
        F.sort_array(F.collect_set(F.length("path"))).alias("lengths"),
    ).first()
    host, path = host_and_path(F.col(url))
    read = pages.withColumn("host", host).withColumn("path", path)
    keys = keys_of(F.col("host"), F.col("path"), shape["labels"], shape["lengths"])
    universe = store(read.select(F.explode(keys).alias("key")).distinct(), "universe")
    verdicts = sorted(r[0] for r in rules.select("verdict").distinct().collect())
    listed = rules.select("verdict", F.concat("host", "path").alias("key"))
    rule, verdict = F.lit(None).cast("string"), F.lit(default)
    fits = []
    for v in verdicts:
        fits.append(fitting(keys, build(listed.filter(F.col("verdict") == v), universe), v))
    if fits:
        best = F.array_max(F.concat(*fits))
        rule, verdict = best["key"], F.coalesce(best["verdict"], F.lit(default))
    return read.withColumn("rule", rule).withColumn("verdict", verdict)
