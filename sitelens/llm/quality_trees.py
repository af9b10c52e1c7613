"""Quality classifier: histogram gradient-boosted trees over document statistics (operator 5).

Each text becomes a row of statistics (shares of character classes, word and line shape,
repetition). Trees are fitted on a bounded sample of labelled rows (``max_train_rows``, by a hash of
the key), which alone is sent to the texts, with histograms of at most ``BINS`` bins a statistic. The
trees are flattened into arrays; every text is scored in its own row, whole batches going through
the arrays with numpy one level at a time. Nothing but the sample is shuffled or collected.

Cases: null and empty texts have zero statistics and get a score like any other; rows without a
usable label are only scored; repeated rows are scored each; without two classes of labels every
score is the labelled share (0.5 without labels); other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.llm.common import held_out, label_sample

BINS = 64
FEATURES = (
    "log_chars", "log_words", "word_length", "upper", "digit", "space", "newline", "non_ascii", "comma_stop",
    "bang", "hash_star", "percent_amp", "dollar", "pipe", "brackets", "other_punct", "distinct_words",
    "top_word", "distinct_lines", "line_length", "symbol_words", "short_words", "byte_entropy", "repeat_words",
)


def _bytes(chars: str) -> list[int]:
    return list(chars.encode())


_CLASSES = [
    list(range(65, 91)), list(range(48, 58)), [32, 9], [10], list(range(128, 256)), _bytes(",."), _bytes("!?"),
    _bytes("#*"), _bytes("%&"), _bytes("$"), _bytes("|"), _bytes("<>[]{}()"), _bytes("\"'`-_:;/\\+=@^~"),
]
_CLASS_OF = np.zeros((256, len(_CLASSES)))
for _i, _c in enumerate(_CLASSES):
    _CLASS_OF[_c, _i] = 1
_SHORT = 3


def statistics(text: bytes) -> list[float]:
    """The values of FEATURES for a UTF-8 text; zeros for an empty one."""
    if not text:
        return [0.0] * len(FEATURES)
    by = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    total = len(text)
    share = (by @ _CLASS_OF) / total
    words = text.split()
    n = len(words)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x]
    distinct = len(counts)
    p = by[by > 0] / total
    fours = len(set(zip(words, words[1:], words[2:], words[3:]))) if n > 3 else max(n - 3, 0)
    return [
        float(np.log1p(total)),
        float(np.log1p(n)),
        (total - n) / max(n, 1),
        *share.tolist(),
        distinct / max(n, 1) ** 0.75,
        max(counts.values(), default=0) / max(n, 1),
        len(set(lines)) / max(len(lines), 1),
        float(np.log1p(total / max(len(lines), 1))),
        sum(c for w, c in counts.items() if not w[:1].isalnum() and w[0] < 128) / max(n, 1),
        sum(c for w, c in counts.items() if len(w) <= _SHORT) / max(n, 1),
        float(-(p * np.log2(p)).sum()),
        1 - fours / (n - 3) if n > 3 else 0.0,
    ]


def statistics_column(text: Column) -> Column:
    """array<double> with the values of FEATURES."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([statistics(t or b"") for t in texts.cast(pa.binary()).to_pylist()], pa.list_(pa.float64()))

    return run(text.cast("string"))


@dataclass
class Trees:
    """All trees in level order, ``2**depth - 1`` inner nodes and ``2**depth`` leaves each:
    ``feature`` and ``cut`` are (trees, inner nodes), ``leaf`` is (trees, leaves)."""

    prior: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``: every row goes one level down each tree per step."""
        margin = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:  # all rows are on one level
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            margin += leaf[node - inner] if len(node) else 0
        return 1 / (1 + np.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, l2: float = 1.0, least: int = 5) -> Trees:
    """Boosted trees on logistic loss. Per node and statistic, gradients are summed into histograms
    (one ``bincount`` over node, statistic and bin), and the best cut of each node is taken."""
    n, f = x.shape if x.ndim == 2 else (0, len(FEATURES))
    inner = 2**depth - 1
    share = y.mean() if n else 0.5
    if n == 0 or share in (0.0, 1.0):
        prior = 0.0 if n == 0 else float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
        return Trees(prior, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(f)]
    cuts = np.full((f, BINS), np.inf)
    binned = np.empty((n, f), np.int64)
    for j, e in enumerate(edges):
        cuts[j, : len(e)] = e
        binned[:, j] = np.searchsorted(e, x[:, j], side="left")  # bin b: at most cut b
    prior = float(np.log(share / (1 - share)))
    margin = np.full(n, prior)
    out = ([], [], [])
    columns = np.arange(f) * BINS
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            slot = ((node - first)[:, None] * (f * BINS) + columns + binned).ravel()
            size = width * f * BINS
            hist = [
                np.bincount(slot, np.repeat(v, f), size).reshape(width, f, BINS).cumsum(2) for v in (grad, hess, np.ones(n))
            ]
            g, h, c = hist
            gt, ht, ct = g[:, :, -1:], h[:, :, -1:], c[:, :, -1:]
            gain = g**2 / (h + l2) + (gt - g) ** 2 / (ht - h + l2) - gt**2 / (ht + l2)
            gain[(c < least) | (ct - c < least) | ~np.isfinite(cuts)[None]] = 0
            best = gain.reshape(width, -1).argmax(1)
            good = gain.reshape(width, -1).max(1) > 1e-6
            j, b = np.divmod(best, BINS)
            feature[first : first + width] = j
            cut[first : first + width] = np.where(good, cuts[j, b], np.inf)  # no gain: all go left
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        leaves = node - inner
        leaf = rate * np.bincount(leaves, grad, inner + 1) / (np.bincount(leaves, hess, inner + 1) + l2)
        margin += leaf[leaves]
        for kept, v in zip(out, (feature, cut, leaf)):
            kept.append(v)
    return Trees(prior, *map(np.array, out))


def train(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, max_train_rows: int = 20_000) -> Trees:
    """Fit on at most ``max_train_rows`` labelled rows outside the held-out fold."""
    chosen = F.broadcast(label_sample(labels, key, label, max_train_rows))  # bounded by its limit
    rows = (
        docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
        .join(chosen, F.col("key") == F.col("label_key"))
        .select(statistics_column(F.col("text")).alias("stats"), "label", "h")
        .orderBy("h", "stats")
        .limit(max_train_rows)
        .toArrow()
    )
    x = np.array(rows["stats"].to_pylist(), float)
    return fit(x, rows["label"].to_numpy().astype(float))


def score_column(model: Trees, text: Column) -> Column:
    """Probability of label 1 for a text."""

    @F.arrow_udf(T.DoubleType())
    def run(texts: pa.Array) -> pa.Array:
        x = np.array([statistics(t or b"") for t in texts.cast(pa.binary()).to_pylist()], float)
        return pa.array(model.predict(x.reshape(-1, len(FEATURES))), pa.float64())

    return run(text.cast("string"))


def classify(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.3
) -> DataFrame:
    """key, held_out, score, predicted for every row of ``docs``."""
    model = train(docs, labels, key, text, label)
    scored = docs.select(F.col(key).alias(key), score_column(model, F.col(text)).alias("score"))
    return scored.select(
        key, held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
