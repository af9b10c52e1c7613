"""Quality rules with n-gram perplexity (operator 6).

Base rules count words, symbols, repeated lines and repeated 8-word windows. The method is a
modified Kneser-Ney model of characters, order 4. Spark reads every distinct text for it, and counts those that a model of
clean text may learn from: they pass the base rules and hold at most ``SHARE`` symbols a word character. What only
other texts hold has the probability that the lower orders leave to unseen grams, so that junk is unlikely however much
of it the corpus has:

* each task reduces its texts to distinct 4-grams with counts (numpy), Spark sums them;
* lower orders use continuation counts, which Spark derives from the distinct 4-grams;
* discounts come from the counts of counts; interpolated probabilities are computed by joins
  of the count tables, and kept for each 4-gram by itself: its 64 bits are the key, nothing is hashed.

Characters, not words, are the units: distinct 4-grams grow far slower with the corpus than word
n-grams, and one model serves all languages (models of one language each told good texts from bad ones less well). Still the model grows with it. Up to ``GATHERED`` entries travel to the tasks as sorted arrays;
of a larger model the most frequent grams do, and what the texts hold of all others is joined in Spark.

For each language, a document's log-perplexity must lie in a band around the language's median.
Its width follows the language's own scatter, and is wider for short texts, whose mean varies more.
The model and both figures are taken over distinct reference texts, so that copies of one text neither narrow the
band for the others nor teach the model that text, and junk widens no band;
a language with fewer than ``FEW_TEXTS`` of them, or without scatter, takes that of all languages.

On 3 980 labelled documents the bands reject 295 of the 301 bad ones that get past the base rules and none of 3 302 good
ones (model of all texts: 42); README has the figures by width.

Cases: null and empty texts have no words and fail the base rules; a null language is a language
of its own; a single document is its own median and stays; repeated rows count once and are
returned each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import broadcast_within, store

ORDER = 4
GATHERED = 1 << 23  # entries (of 12 bytes) of a model that travels to the tasks
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
SHARE = 0.01  # symbols a word character up to which a text teaches the model
FEW_TEXTS = 10  # distinct texts on which a language's own scatter must rest
START, END = 0, 1  # code points that pad a text; as text they are read as 2
_MIX = np.uint64(0x9E3779B97F4A7C15)


# ---- base rules ------------------------------------------------------------------------------


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Word positions inside a window of ``window`` words that occurs twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(window):
        key = (key ^ h[i : i + n]) * _MIX
        key ^= key >> np.uint64(29)
    order = np.sort(key)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return 0
    at = np.flatnonzero(np.isin(key, again)).tolist()
    seen: dict[tuple, list[int]] = {}
    for i in at:  # equal hashes only propose; equal words decide
        seen.setdefault(tuple(words[i : i + window]), []).append(i)
    cover = np.zeros(len(words) + 1, np.int64)
    for starts in seen.values():
        if len(starts) > 1:
            for i in starts:
                cover[i] += 1
                cover[i + window] -= 1
    return int((np.cumsum(cover[:-1]) > 0).sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a UTF-8 text. ``bytes.split``
    cuts at exactly the ASCII white space that separates words."""
    words = text.split()
    by = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = len(text) - int(by[128:192].sum())  # continuation bytes are no characters
    lines = [x for x in text.split(b"\n") if x.split(None, 1)]
    return (
        len(words),
        chars - int(by[9:14].sum()) - int(by[32]),
        int(by[list(SYMBOLS)].sum()),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def is_reference(text: bytes, share: float = SHARE) -> bool:
    """Does the text pass the base rules, with few symbols?"""
    words = text.split()
    if len(words) < 20:
        return False
    symbols = sum(map(text.count, (bytes([c]) for c in SYMBOLS)))
    if symbols > share * sum(map(len, words)):
        return False
    return 100 * repeated_words(words) <= 30 * len(words)


# ---- counting --------------------------------------------------------------------------------


def code_points(text: bytes) -> np.ndarray:
    """A text's UTF-16 units (characters, but for the rarest planes) between three START and one END."""
    cp = np.frombuffer(text.decode("utf-8", "replace").encode("utf-16-le", "surrogatepass"), np.uint16)
    out = np.empty(len(cp) + ORDER, np.uint64)
    out[: ORDER - 1] = START
    out[ORDER - 1 : -1] = np.maximum(cp, 2)
    out[-1] = END
    return out


def grams(points: np.ndarray) -> np.ndarray:
    """Packed 4-grams, the last character lowest: one for each character and the END."""
    n = len(points) - ORDER + 1
    key = points[:n].copy()
    for i in range(1, ORDER):
        key = (key << np.uint64(16)) | points[i : i + n]
    return key


def _texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, n, seen) of a partition: how often reference texts and all texts hold each gram; distinct grams of each batch,
    merged as they pile up. A text that stands in ``copies`` rows counts for its share in each."""
    keys, counts, seen, pending = [], [], [], 0

    def merged():
        k, where = np.unique(np.concatenate(keys), return_inverse=True)
        return k, np.bincount(where, np.concatenate(counts)), np.bincount(where, np.concatenate(seen))

    for batch in batches:
        alike: dict[tuple[int, bool], list[np.ndarray]] = {}
        for text, copies, share in zip(_texts(batch, "text"), *(batch.column(i).to_pylist() for i in (1, 2))):
            if text:
                teaches = share is None or is_reference(text, share)
                alike.setdefault((copies, teaches), []).append(grams(code_points(text)))
        for (copies, teaches), found in alike.items():
            k, c = np.unique(np.concatenate(found), return_counts=True)
            keys.append(k)
            seen.append(c / copies)
            counts.append(c / copies * teaches)
            pending += len(k)
        if pending > 4_000_000:
            k, c, all_ = merged()
            keys, counts, seen, pending = [k], [c], [all_], 0
    if keys:
        k, c, all_ = merged()
        yield pa.record_batch({"gram": k.view(np.int64), "n": c, "seen": all_})


def gram_counts(docs: DataFrame, text: str, distinct: bool = False, share: float | None = None) -> DataFrame:
    """gram, n, seen (long) over all texts of ``docs``, or over the distinct ones. With ``share``, n counts reference texts
    only (see ``is_reference``), and seen all. Texts do not travel for that: only the hashes of repeated ones do, with
    their numbers of rows."""
    part = docs.select(F.col(text).cast("string").alias("text"))
    copies = F.lit(1).cast("long")
    if distinct:
        repeated = part.groupBy(F.xxhash64("text").alias("same")).agg(F.count("*").alias("copies")).filter("copies > 1")
        part = part.join(broadcast_within(repeated, 2_000_000), F.xxhash64("text") == F.col("same"), "left")
        copies = F.coalesce("copies", copies)
    part = part.select("text", copies.alias("copies"), F.lit(share).cast("double").alias("share"))
    part = part.mapInArrow(_count, "gram long, n double, seen double")
    return part.groupBy("gram").agg(*(F.round(F.sum(c)).cast("long").alias(c) for c in ("n", "seen")))


# ---- model -----------------------------------------------------------------------------------


def _discounted(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """counts(gram, context, n) -> (gram, own) with the discounted share of the context's mass, and (context, gamma) with
    the mass that each context leaves to the order below."""
    few = {i: F.sum((F.col("n") == i).cast("long")) for i in (1, 2, 3, 4)}
    n1, n2, n3, n4 = (x or 0 for x in counts.agg(*few.values()).first())
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.0

    def d(k, a, b):
        return min(max(k - (k + 1) * y * b / a, 0.1), k - 0.05) if a else 0.5 * k

    d1, d2, d3 = d(1, n1, n2), d(2, n2, n3), d(3, n3, n4)
    cut = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
    contexts = counts.groupBy("context").agg(F.sum("n").alias("total"), F.sum(cut).alias("cut"))
    own = counts.join(contexts, "context").select("gram", ((F.col("n") - cut) / F.col("total")).alias("own"))
    return own, contexts.select("context", (F.col("cut") / F.col("total")).alias("gamma"))


def _suffix(gram: str, order: int) -> Column:
    return F.expr(f"{gram} & {(1 << (16 * order)) - 1}L")


def _level(counts: DataFrame, order: int) -> DataFrame:
    return counts.withColumn("context", F.expr("shiftrightunsigned(gram, 16)") if order > 1 else F.lit(0).cast("long"))


def kneser_ney(counts: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """gram, logp: interpolated modified Kneser-Ney log-probability of each 4-gram's last character, for the grams of
    ``wanted``, counted or not (those of ``counts`` by default).

    Every table is keyed by distinct grams, whose number the alphabet bounds. Lower orders count the
    distinct grams that extend a suffix to the left."""
    counted = counts.filter("n > 0")
    tables, needed = {ORDER: counted}, {ORDER: counted if wanted is None else wanted}
    for order in range(ORDER - 1, 0, -1):
        longer = tables[order + 1].select(_suffix("gram", order).alias("gram"))
        tables[order] = store(longer.groupBy("gram").agg(F.count("*").alias("n")), f"grams{order}")
        if wanted is None:
            needed[order] = tables[order]
        else:
            needed[order] = store(needed[order + 1].select(_suffix("gram", order).alias("gram")).distinct(), f"needed{order}")
    unit = tables[1].count() + 1
    below = None
    for order in range(1, ORDER + 1):
        own, contexts = _discounted(_level(tables[order], order))
        here = _level(needed[order], order).select("gram", "context").join(own, "gram", "left").join(contexts, "context", "left")
        if below is None:
            here = here.withColumn("lower", F.lit(1 / unit))
        else:
            lower = below.select(F.col("gram").alias("suffix"), F.col("p").alias("lower"))
            here = here.withColumn("suffix", _suffix("gram", order - 1)).join(lower, "suffix")
        p = F.coalesce("own", F.lit(0.0)) + F.coalesce("gamma", F.lit(1.0)) * F.col("lower")
        below = here.select("gram", p.alias("p"))
    return below.select("gram", F.log("p").alias("logp"))


def sorted_arrays(model: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The model as sorted grams and their log-probabilities."""
    rows = model.select("gram", F.col("logp").cast("float").alias("logp")).toArrow()
    gram, p = rows["gram"].to_numpy().view(np.uint64), rows["logp"].to_numpy()
    order = np.argsort(gram)
    return gram[order], p[order]


def split(model: DataFrame, counts: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """(head, tail) of a model: at most ``most`` entries, and the others if there are any. The head holds the grams
    that the texts hold most often, so that none of the tail stands in many."""
    if model.count() <= most:
        return model, None
    power = F.floor(F.log2(F.greatest("seen", F.lit(1)))).cast("int")
    sizes = {r["power"]: r["size"] for r in counts.groupBy(power.alias("power")).agg(F.count("*").alias("size")).collect()}
    least = held = 0
    for p in sorted(sizes, reverse=True):
        held += sizes[p]
        if held > most:
            least = p + 1
            break
    both = store(model.join(counts.select("gram", power.alias("power")), "gram"), "split-model")
    return both.filter(F.col("power") >= least).drop("power"), both.filter(F.col("power") < least).drop("power")


class Scorer:
    """Looks up grams in the sorted arrays."""

    def __init__(self, gram: np.ndarray, p: np.ndarray):
        self.gram, self.p = gram, p

    def __call__(self, text: bytes) -> tuple[float, int, np.ndarray]:
        """Sum of the log-probabilities of a text's known grams, number of all its grams, and the unknown ones."""
        found = grams(code_points(text))
        if not len(self.gram):
            return 0.0, len(found), found
        at = np.searchsorted(self.gram, found)
        at[at == len(self.gram)] = 0
        known = self.gram[at] == found
        if known.all():
            return float(self.p[at].sum(dtype=np.float64)), len(found), found[:0]
        return float(self.p[at[known]].sum(dtype=np.float64)), len(found), found[~known]


def score(docs: DataFrame, key: str, text: str, lang: str, head: DataFrame, tail: DataFrame | None = None) -> DataFrame:
    """One row a document: its key, language, hash of the text, base counts and log-perplexity (null without text).
    ``head`` and ``tail`` hold every gram of the texts."""
    arrays = docs.sparkSession.sparkContext.broadcast(sorted_arrays(head))
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    partly = tail is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*arrays.value)
        for batch in batches:
            texts = _texts(batch, "text")
            base = np.array([base_counts(t) for t in texts], np.int64).reshape(-1, 5)
            total, size, rare, times = [], [], [], []
            for t in texts:
                logp, n, unknown = scorer(t) if t else (0.0, 0, np.zeros(0, np.uint64))
                total.append(logp)
                size.append(n)
                k, c = np.unique(unknown, return_counts=True)
                rare.append(k.view(np.int64))
                times.append(c)
            more = [pa.array(x, pa.list_(pa.int64())) for x in (rare, times)] if partly else []
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *(pa.array(base[:, i]) for i in range(5)), pa.array(total, pa.float64()), pa.array(size, pa.int64()), *more],
                names=["key", "lang", "text_hash", *columns, "total", "size", *["rare", "times"][: len(more)]],
            )

    words = F.col(text).cast("string")
    narrow = docs.select(
        F.col(key).alias("key"), F.col(lang).cast("string").alias("lang"), F.xxhash64(words).alias("text_hash"), words.alias("text")
    )
    kind = narrow.schema["key"].dataType.simpleString()
    schema = f"key {kind}, lang string, text_hash long, {', '.join(c + ' long' for c in columns)}, total double, size long"
    if tail is None:
        scored = narrow.mapInArrow(run, schema)
    else:
        scored = narrow.mapInArrow(run, f"{schema}, rare array<long>, times array<long>")
        scored = store(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
        each = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("g")).select("row", F.col("g.rare").alias("gram"), "g.times")
        rest = each.join(tail, "gram").groupBy("row").agg(F.sum(F.col("times") * F.col("logp")).alias("rest"))
        scored = scored.drop("rare", "times").join(rest, "row", "left")
        scored = scored.withColumn("total", F.col("total") + F.coalesce("rest", F.lit(0.0)))
    log_ppl = F.when(F.col("size") > 0, -F.col("total") / F.col("size"))
    return scored.select("key", "lang", "text_hash", *columns, log_ppl.alias("log_ppl"))


def _median(value: Column) -> Column:
    return F.percentile_approx(value, 0.5, 10_000)


def bands(scored: DataFrame, width: float, least: float, share: float = SHARE) -> DataFrame:
    """``scored`` with ``low`` and ``high`` log-perplexity for its language and length.

    The mean over n characters scatters with one over the root of n: the language's scatter a
    character is the median of the distances from the language's median times root n (times 1.4826,
    which makes it a standard deviation), and ``least`` is what remains for endless texts. Medians are
    over a language's distinct reference texts, or if it has none over those that pass the base rules. The pooled scatter
    leaves out distances of 0: those of the texts that are themselves a median."""
    passed = scored.filter(~F.col("base_failed") & F.col("log_ppl").isNotNull())
    few = F.col("n_symbols") <= share * F.col("word_chars")
    texts = passed.groupBy("lang", "text_hash").agg(*(F.first(c).alias(c) for c in ("log_ppl", "word_chars", "n_symbols")))
    texts = store(texts.select("lang", "log_ppl", F.greatest("word_chars", F.lit(1)).alias("n"), few.alias("few")), "distinct-texts")
    best = texts.groupBy(F.col("lang").alias("of")).agg(F.max("few").alias("best"))
    texts = texts.join(broadcast_within(best, 100_000), F.col("lang").eqNullSafe(F.col("of"))).filter("few = best")
    mid = texts.groupBy("lang").agg(_median(F.col("log_ppl")).alias("median"))
    mid = broadcast_within(mid.select(F.col("lang").alias("mid_lang"), "median"), 100_000)
    off = texts.join(mid, F.col("lang").eqNullSafe(F.col("mid_lang")))
    off = off.select("lang", "median", (F.abs(F.col("log_ppl") - F.col("median")) * F.sqrt("n")).alias("off"))
    own = off.groupBy("lang").agg(F.first("median").alias("median"), _median(F.col("off")).alias("own"), F.count("*").alias("texts"))
    pooled = off.filter("off > 0").agg(_median(F.col("off"))).first()[0] or 0.0
    scatter = F.when((F.col("texts") < FEW_TEXTS) | (F.col("own") == 0), F.lit(pooled)).otherwise(F.col("own"))
    known = broadcast_within(own.select(F.col("lang").alias("known_lang"), "median", scatter.alias("scatter")), 100_000)
    scored = scored.join(known, F.col("lang").eqNullSafe(F.col("known_lang")), "left").drop("known_lang")
    n = F.greatest(F.col("word_chars"), F.lit(1))
    half = width * F.sqrt(F.lit(least**2) + (1.4826 * F.col("scatter")) ** 2 / n)
    return scored.withColumn("low", F.col("median") - half).withColumn("high", F.col("median") + half)


def judge(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", width: float = 5.5, least: float = 0.008,
    gathered: int = GATHERED, share: float = SHARE,
) -> DataFrame:
    """Base counts, ``base_failed``, ``log_ppl``, the band and ``kept`` for every row of ``docs``. At most
    ``gathered`` entries of the model are gathered and sent to the tasks."""
    counts = store(gram_counts(docs, text, distinct=True, share=share), "grams")
    head, tail = split(store(kneser_ney(counts, counts), "model"), counts, gathered)
    scored = score(docs, key, text, lang, head, tail)
    scored = scored.withColumn(
        "base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    )
    banded = bands(store(scored, "perplexity"), width, least, share)
    inside = F.coalesce(F.col("log_ppl").between(F.col("low"), F.col("high")), F.lit(True))
    return banded.withColumn("kept", ~F.col("base_failed") & inside).drop("text_hash").withColumnRenamed("key", key)
