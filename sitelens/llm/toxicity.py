"""Toxicity: linear classifier on character n-grams scaled by naive Bayes log-count ratios (operator 10).

A text is lower-cased, white space becomes one space, and its 3- to 6-grams are hashed to
``2**HASH_BITS`` features; a feature is present or absent. Over all labelled training rows Spark counts
in how many toxic and clean texts each feature occurs; the log ratio of the smoothed shares scales
the feature. A logistic regression on the scaled features is then fitted on a bounded sample
of labelled rows (``max_train_rows``, balanced by class weights). The product of ratio and weight is
one array of bounded size, with which every text is scored in its own row.

Cases: null and empty texts have no features and get the score of the intercept; rows without a
usable label are only scored; repeated rows are scored each; without two classes of labels every
score is the smoothed labelled share (0.5 without labels); other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.llm.common import broadcast_within, held_out, label_of, label_sample

HASH_BITS = 20
SIZES = (3, 4, 5, 6)
_MIX = np.uint32(0x9E3779B1)


def hashes(text: str | None) -> list[np.ndarray]:
    """Feature numbers of the n-grams at each position, one array for each n; a text is padded by
    one space on both sides, so that words have edges."""
    points = np.frombuffer((" " + " ".join((text or "").lower().split()) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) <= 2:
        return []
    out, key = [], points * _MIX
    for n in range(2, SIZES[-1] + 1):
        if len(points) < n:
            break
        key = (key[: len(points) - n + 1] ^ points[n - 1 :]) * _MIX
        key = key ^ (key >> np.uint32(15))
        if n in SIZES:
            out.append((key * np.uint32(0x85EBCA6B)) >> np.uint32(32 - HASH_BITS))
    return out


class Distinct:
    """Distinct feature numbers of one text, without sorting: each number remembers its last position."""

    def __init__(self):
        self.last = np.zeros(1 << HASH_BITS, np.int32)

    def __call__(self, numbers: list[np.ndarray]) -> np.ndarray:
        if not numbers:
            return np.zeros(0, np.uint32)
        h = np.concatenate(numbers)
        at = np.arange(len(h), dtype=np.int32)
        self.last[h] = at
        return h[self.last[h] == at]


def labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """key, text, label of the training rows (outside the held-out fold). Labels travel to the texts
    when their counted number allows it, else both sides are joined by key."""
    known = broadcast_within(label_of(labels, key, label), 2_000_000)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).filter(~held_out(F.col("key")))
    return rows.join(known, F.col("key") == F.col("label_key")).select("key", "text", "label")


def feature_counts(rows: DataFrame) -> DataFrame:
    """feature, toxic, clean: in how many labelled texts a feature occurs (feature -1: all texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distinct, counts = Distinct(), np.zeros((2, (1 << HASH_BITS) + 1), np.int64)
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[label, distinct(hashes(text))] += 1
                counts[label, -1] += 1
        feature = np.flatnonzero(counts.any(0))
        number = np.where(feature == 1 << HASH_BITS, -1, feature)
        yield pa.record_batch({"feature": number, "toxic": counts[1, feature], "clean": counts[0, feature]})

    parts = rows.select("text", "label").mapInArrow(run, "feature long, toxic long, clean long")
    return parts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def log_count_ratios(counts: DataFrame, smooth: float = 1.0, least: int = 4, floor: float = 1.0) -> tuple[np.ndarray, int, int]:
    """ratio of each of the 2**HASH_BITS features, and the numbers of toxic and clean texts. A feature
    in fewer than ``least`` texts, or with a ratio below ``floor`` (which says little), gets 0."""
    rows = counts.toArrow()
    feature, toxic, clean = (rows[c].to_numpy() for c in ("feature", "toxic", "clean"))
    n1, n0 = (int(v[feature == -1].sum()) for v in (toxic, clean))
    ratio = np.zeros(1 << HASH_BITS)
    seen = feature >= 0
    both = np.log((toxic + smooth) / (n1 + 2 * smooth)) - np.log((clean + smooth) / (n0 + 2 * smooth))
    both[(toxic + clean < least) | (np.abs(both) < floor)] = 0
    ratio[feature[seen]] = both[seen]
    return ratio, n1, n0


def fit(texts: list[str], y: np.ndarray, ratio: np.ndarray, steps: int = 120, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on ratio-scaled presence features, each text scaled to unit length; both
    classes weigh the same. Gradient steps with momentum over a compressed sparse matrix."""
    distinct = Distinct()
    parts = [distinct(hashes(t)) for t in texts]
    parts = [p[ratio[p] != 0] for p in parts]
    length = np.array([len(p) for p in parts])
    column, row = np.concatenate([*parts, np.zeros(0, np.uint32)]).astype(np.int64), np.repeat(np.arange(len(parts)), length)
    used, column = np.unique(column, return_inverse=True)
    value = ratio[used][column]
    value /= np.sqrt(np.bincount(row, value**2, len(parts)))[row]
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w, b, vw, vb, rate = np.zeros(len(used)), 0.0, 0.0, 0.0, 8.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(np.bincount(row, value * w[column], len(parts)) + b)))
        error = weight * (p - y)
        vw = 0.9 * vw + np.bincount(column, value * error[row], len(used)) + l2 * w
        vb = 0.9 * vb + error.sum()
        w, b = w - rate * vw, b - rate * vb
    out = np.zeros(1 << HASH_BITS)
    out[used] = w
    return out, float(b)


def within_budget(lengths: list[int], most: int) -> list[int]:
    """Numbers of the texts to read, in their order: each that fits in what is left of ``most``. One that does not fit
    is passed over and ends nothing; if none fits, the shortest is read."""
    out, left = [], most
    for i, n in enumerate(lengths):
        if n <= left:
            out.append(i)
            left -= n
    return out or ([int(np.argmin(lengths))] if lengths else [])


def regression_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, max_rows: int, max_chars: int) -> list:
    """(text, label) of the regression's rows: one text a chosen label, in the order of the key's hash, from each class
    within half of ``max_chars``. Lengths decide before any text is gathered, so the layout of ``docs`` does not matter."""
    sample = [label_sample(labels.filter(F.col(label) == k), key, label, max_rows // 2) for k in (0, 1)]
    chosen = F.broadcast(sample[0].union(sample[1]))  # bounded by its limits
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumns({"same": F.xxhash64("text"), "chars": F.coalesce(F.length("text"), F.lit(0))})
    found = rows.join(chosen, F.col("key") == F.col("label_key")).groupBy("label_key", "label", "h").agg(F.min(F.struct("same", "chars")).alias("one"))
    found = found.select("label_key", "label", "h", "one.*").orderBy("h", "label_key").collect()
    read = []
    for k in (0, 1):
        mine = [r for r in found if r["label"] == k]
        read += [mine[i] for i in within_budget([r["chars"] for r in mine], max_chars // 2)]
    if not read:
        return []
    schema = T.StructType([rows.schema["key"], T.StructField("label", T.IntegerType()), T.StructField("place", T.IntegerType()), T.StructField("same", T.LongType())])
    wanted = docs.sparkSession.createDataFrame([(r["label_key"], r["label"], i, r["same"]) for i, r in enumerate(read)], schema)
    picked = rows.select("key", "text", "same").join(F.broadcast(wanted), ["key", "same"])
    return picked.groupBy("place", "label").agg(F.first("text").alias("text")).orderBy("place").collect()


def train(
    docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, max_train_rows: int = 4_000, max_chars: int = 12_000_000
) -> tuple[np.ndarray, np.ndarray, float]:
    """(ratio, ratio x weight of each feature, intercept). Counts cover all labelled rows. The regression takes
    at most ``max_train_rows`` labels, half from each class as far as there are, by a hash of the key, and
    of each class whole texts of at most half of ``max_chars`` characters together."""
    ratio, n1, n0 = log_count_ratios(feature_counts(labelled(docs, labels, key, text, label)))
    if not n1 or not n0:
        return ratio, np.zeros(1 << HASH_BITS), float(np.log((n1 + 0.5) / (n0 + 0.5)))
    picked = regression_rows(docs, labels, key, text, label, max_train_rows, max_chars)
    weight, intercept = fit([r["text"] for r in picked], np.array([r["label"] for r in picked], float), ratio)
    return ratio, ratio * weight, intercept


class Scorer:
    """Probability of the toxic class: the scaled weights of a text's distinct features, over the length
    of its scaled features, plus the intercept."""

    def __init__(self, ratio: np.ndarray, weight: np.ndarray, intercept: float):
        self.square, self.weight, self.intercept = ratio.astype(np.float32) ** 2, weight.astype(np.float32), intercept
        self.distinct = Distinct()

    def __call__(self, text: str | None) -> float:
        f = self.distinct(hashes(text))
        length = float(np.sqrt(self.square[f].sum(dtype=np.float64)))
        margin = float(self.weight[f].sum(dtype=np.float64)) / length if length else 0.0
        return 1 / (1 + float(np.exp(-(margin + self.intercept))))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = 0.5) -> DataFrame:
    """key, held_out, score, predicted for every row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, key, text, label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model.value)
        for batch in batches:
            scores = pa.array([scorer(t) for t in batch.column(1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], names=["key", "score"])

    narrow = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = narrow.schema["key"].dataType.simpleString()
    return narrow.mapInArrow(run, f"key {kind}, score double").select(
        F.col("key").alias(key),
        held_out(F.col("key")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
