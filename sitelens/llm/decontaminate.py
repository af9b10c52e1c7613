"""Benchmark decontamination with a distributed positional inverted index (operator 4).

DataFrame functions only. Texts are cut into words in their own rows, and the positions of every benchmark
term are written as postings (row, position, term): a map-only step, laid out by document. A posting of
an end mark carries each document's word count. The benchmark's windows (``window`` consecutive
words; a shorter item is one window) are the phrases. From the postings' own term counts each window
knows its rarest terms:

1. postings of the rarest and the second rarest term give candidate places (row, window start);
2. a place at which another of the three rarest terms stands within ``slop`` words of where it should goes on;
3. exact phrases: all three stand right there, and the lists of all other terms, shifted by their offsets, hold the place;
4. proximity matches: of all the window's terms at most ``missing`` are not within ``slop`` words of their places.

So a passage with a word inserted, dropped, moved by up to ``slop`` or replaced is found, the rarest one included: two of the three
rarest remain whichever single word is replaced. Two replaced words are found unless both are among the three.
Several places may tell of one passage, each with its own count of terms.

Every join is by (row, term, place), so a common passage, term or document spreads over all tasks. Tables
derived from the benchmark, the stated query set, are broadcast only when their counted rows are few.

Cases: a null text has no words; a null item id counts as ''; items without words match nothing; equal
windows of several items are one phrase that names all of them; repeated documents are returned each;
empty tables give no hits; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitelens.llm.common import ascii_lower, broadcast_within, store

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
END = -1  # term number of the end mark
FEW = 1_000_000  # rows of a narrow table that may be broadcast (tens of MB)


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; null: none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), NOT_WORD), "")


def windows(items: DataFrame, key: str, text: str, window: int) -> tuple[DataFrame, DataFrame]:
    """(phrases, terms): phrases(wid, n, items array<string>) and terms(wid, off, word)."""
    cut = items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item"), words(F.col(text)).alias("w"))
    each = cut.filter(F.size("w") > 0).select(
        "item", F.explode(F.expr(f"transform(sequence(0, greatest(size(w) - {window}, 0)), i -> slice(w, i + 1, {window}))")).alias("w")
    )
    phrases = each.groupBy("w").agg(F.sort_array(F.collect_set("item")).alias("items"))
    phrases = store(phrases.withColumn("wid", F.monotonically_increasing_id()), "phrases")
    terms = phrases.select("wid", F.posexplode("w").alias("off", "word"))
    return phrases.select("wid", F.size("w").alias("n"), "items"), terms


def build_index(docs: DataFrame, key: str, text: str, vocabulary: DataFrame) -> DataFrame:
    """Postings (rid, pos, term, key) of the terms of ``vocabulary`` (word, term). ``rid`` numbers the
    rows; the posting of END stands after the last word and alone carries the key."""
    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("key"), F.col(text).alias("text"))
    marked = F.concat(words(F.col("text")), F.array(F.lit("")))
    rows = numbered.select("rid", "key", F.posexplode(marked).alias("pos", "word"))
    end = vocabulary.sparkSession.range(1).select(F.lit("").alias("word"), F.lit(END).cast("long").alias("term"))
    known = broadcast_within(vocabulary.select("word", "term").unionByName(end), FEW)
    found = rows.join(known, "word").select("rid", "pos", "term", F.when(F.col("term") == END, F.col("key")).alias("key"))
    return store(found, "postings")


def rank_terms(index: DataFrame, vocabulary: DataFrame, terms: DataFrame) -> DataFrame:
    """terms with ``term``, ``rank`` (1: rarest in the corpus; terms that never occur come last) and ``whole``: all terms
    of the window occur."""
    freq = index.filter(F.col("term") != END).groupBy("term").agg(F.count("*").alias("freq"))
    known = vocabulary.join(freq, "term", "left").select("word", "term", F.coalesce("freq", F.lit(0)).alias("freq"))
    counted = terms.join(known, "word")
    by = Window.partitionBy("wid")
    rank = F.row_number().over(by.orderBy(F.col("freq") == 0, "freq", "off"))
    ranked = counted.withColumn("rank", rank).withColumn("whole", F.min("freq").over(by) > 0)
    return store(ranked.filter("freq > 0 OR rank > 3").select("wid", "off", "term", "rank", "whole"), "ranked-terms")


def _at(index: DataFrame, terms: DataFrame, places: DataFrame, slop: int) -> DataFrame:
    """Places (rid, wid, start) with each (off, there) of ``terms`` (wid, term, off) that stands within ``slop`` words of where it
    should; ``there``: right there. Positions meet by blocks of ``2 * slop + 2`` words, so one term filling a long
    text makes no pairs beyond its neighbourhood."""
    width = 2 * slop + 2
    block = lambda c: F.floor(c / width)
    wanted = places.join(broadcast_within(terms, FEW), "wid").withColumn("at", F.col("start") + F.col("off"))
    wanted = wanted.withColumn(
        "block", F.explode(F.array_distinct(F.array(block(F.col("at") - slop), block(F.col("at") + slop))))
    )
    used = broadcast_within(terms.select("term").distinct(), FEW)
    there = index.join(used, "term", "left_semi").select("rid", "term", "pos", block(F.col("pos")).alias("block"))
    met = wanted.join(there, ["rid", "term", "block"]).filter(F.abs(F.col("pos") - F.col("at")) <= slop)
    return met.groupBy("rid", "wid", "start", "off").agg(F.max(F.col("pos") == F.col("at")).alias("there"))


def candidates(index: DataFrame, phrases: DataFrame, ranked: DataFrame, rank: int) -> DataFrame:
    """Places (rid, wid, start) that the postings of the windows' terms of a rank propose."""
    first = ranked.filter(F.col("rank") == rank).select("wid", "term", "off")
    return index.join(broadcast_within(first, FEW), "term").select("rid", "wid", (F.col("pos") - F.col("off")).alias("start"))


def matches(index: DataFrame, phrases: DataFrame, ranked: DataFrame, slop: int, missing: int) -> tuple[DataFrame, DataFrame]:
    """(exact, near): places (rid, wid, n, start) of exact phrases, and (rid, wid, n, start, terms) of proximity matches, exact ones
    among them; ``terms``: how many stand within ``slop`` words of their places."""
    sizes = broadcast_within(phrases.select("wid", "n"), FEW)
    rare = ranked.filter("rank <= 3").select("wid", "term", "off", "rank")
    by_first, by_second = candidates(index, phrases, ranked, 1), candidates(index, phrases, ranked, 2)
    # the others of the three rarest, around the places that one of them proposes
    pair = _at(index, rare.filter("rank > 1").select("wid", "term", "off"), by_first, slop)
    pair = pair.unionByName(_at(index, rare.filter("rank = 3").select("wid", "term", "off"), by_second, slop))
    short = by_first.join(sizes.filter("n = 1"), "wid").select("rid", "wid", "start")
    places = store(pair.select("rid", "wid", "start").distinct().unionByName(short), "places")

    # all terms of the places that are left
    terms = ranked.select("wid", "term", "off")
    near = _at(index, terms, places, slop).groupBy("rid", "wid", "start").agg(
        F.count("*").alias("terms"), F.sum(F.col("there").cast("int")).alias("there")
    )
    near = store(near.join(sizes, "wid"), "near")
    exact = near.filter("there = n").select("rid", "wid", "n", "start")
    close = near.filter((F.col("terms") >= F.col("n") - missing) & (F.col("terms") >= F.least("n", F.lit(2))))
    return exact, close.select("rid", "wid", "n", "start", "terms")


def find(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
    item_text: str = "text", window: int = 10, slop: int = 3, missing: int = 2,
) -> DataFrame:
    """One row a match: key, item, kind (exact, near), start (word number), n_words and terms (in place or close by)."""
    index, phrases, exact, near = _search(docs, items, key, text, item_key, item_text, window, slop, missing)
    named = broadcast_within(phrases.select("wid", "items"), FEW)
    kinds = exact.withColumns({"kind": F.lit("exact"), "terms": F.col("n").cast("long")}).unionByName(
        near.join(exact, ["rid", "wid", "start"], "left_anti").withColumn("kind", F.lit("near"))
    )
    ends = index.filter(F.col("term") == END).select("rid", "key")
    rows = kinds.join(named, "wid").join(ends, "rid")
    return rows.select(
        F.col("key").alias(key), F.explode("items").alias("item"), "kind", F.col("start").cast("long").alias("start"), F.col("n").cast("long").alias("n_words"), "terms"
    )


def _search(docs, items, key, text, item_key, item_text, window, slop, missing):
    phrases, terms = windows(items, item_key, item_text, window)
    vocabulary = store(
        terms.select("word").distinct().withColumn("term", F.monotonically_increasing_id()), "vocabulary"
    )
    index = build_index(docs, key, text, vocabulary)
    ranked = rank_terms(index, vocabulary, terms)
    exact, near = matches(index, phrases, ranked, slop, missing)
    return index, phrases, exact, near


def report(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
    item_text: str = "text", window: int = 10, slop: int = 3, missing: int = 2,
) -> DataFrame:
    """One row a document: key, n_words, n_hit (words inside exact windows), items (their sorted ids),
    n_near (windows found in proximity that the document nowhere holds exactly) and near_items (their sorted ids)."""
    index, phrases, exact, near = _search(docs, items, key, text, item_key, item_text, window, slop, missing)
    named = broadcast_within(phrases.select("wid", "items"), FEW)
    # covered words of a document: its windows by start, each adds what lies past the last end
    covered = F.aggregate(
        F.sort_array("spans"),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, s: F.struct(
            F.greatest(a["end"], s["end"]).alias("end"),
            (a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["end"]), F.lit(0))).alias("n"),
        ),
        lambda a: a["n"],
    )
    hits = (
        exact.join(named, "wid")
        .groupBy("rid")
        .agg(
            F.collect_set(F.struct(F.col("start").alias("start"), (F.col("start") + F.col("n")).alias("end"))).alias("spans"),
            F.collect_set("items").alias("lists"),
        )
        .select("rid", covered.cast("long").alias("n_hit"), F.sort_array(F.array_distinct(F.flatten("lists"))).alias("items"))
    )
    only = near.select("rid", "wid").distinct().join(exact.select("rid", "wid").distinct(), ["rid", "wid"], "left_anti")
    close = only.join(named, "wid").groupBy("rid").agg(
        F.count("*").alias("n_near"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("near_items")
    )
    ends = index.filter(F.col("term") == END).select("rid", "key", F.col("pos").cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    return ends.join(hits, "rid", "left").join(close, "rid", "left").select(
        F.col("key").alias(key),
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", none).alias("items"),
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.coalesce("near_items", none).alias("near_items"),
    )
