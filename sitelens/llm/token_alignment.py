"""Alignment of two tokenizers over the same bytes by interval coalescing (operator 13).

Each text, with a space before it, is encoded by both tokenizers, and every token becomes an interval of bytes.
All intervals of a stretch are sorted by start (lexsort), the running maximum of their ends is taken
(``maximum.accumulate``), and a group breaks where a start reaches it: there tokens of both sides end. Inside a group
overlaps are expanded to links, each A token with its range of B tokens.

Neither tokenizer joins a non-space character with a following space, or a letter with a following stop, so a text is cut
before each single space between two non-space characters and between letter and stop. The stretches (mostly words) are
aligned by themselves: many new ones at once, known ones from a bounded memory that a worker keeps from task to task.
Stretches with other white space at their edges are encoded one by one. A text in which a stretch does not decode to its own bytes is encoded whole and judged as such.

The number of documents that hold an id pair comes from each document's distinct pairs. The table of pairs grows with the
corpus: its most frequent ``gathered`` entries travel to the tasks as sorted arrays, the others are joined in Spark.

Cases: null and empty texts, and texts that either tokenizer does not reproduce byte for byte, have no tokens (zeros and an
empty groups column); special tokens' strings are plain text; repeated rows are documents of their own; a null key is
kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import broadcast_within, byte_level, store

GATHERED = 1 << 22  # entries (of 13 bytes) of the pair table that travel to the tasks
STOPS = ".,;:!?"
CUT = re.compile(rf"(?<=\S)(?= \S)|(?<=[A-Za-zÀ-ÖØ-öø-ſ])(?=[{STOPS}])")
PLAIN = re.compile(r" \S(?:.*\S)?", re.DOTALL)
AFTER = re.compile(rf"[{STOPS}](?:.*\S)?", re.DOTALL)  # what follows a letter
LONG = 64  # characters of a stretch that is still remembered


# ---- tokens and their bytes ------------------------------------------------------------------


class SideA:
    """A byte-level BPE of the ``tokenizers`` library. Text of Latin letters, digits and signs, on whose classes all versions
    of Unicode agree, goes through the faster ``tiktoken`` with the same vocabulary, if its ids rise as its merges do."""

    LATIN = re.compile("[\t\n\r -~\u00a1-\u00ac\u00ae-\u017f]*")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        byte_of = byte_level()
        vocabulary = self.tokenizer.get_vocab()
        self.token = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.token[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.length = np.array([len(t) for t in self.token], np.int64)
        self.fast = self._ranked(vocabulary)

    def _ranked(self, vocabulary: dict[str, int]):
        import public_tokenizers
        import tiktoken

        model = json.loads(self.tokenizer.to_str())
        merges = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["model"]["merges"]]
        splits = (model["pre_tokenizer"] or {}).get("type") == "ByteLevel" and model["normalizer"] is None
        if not splits or merges != sorted(merges):
            return None
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = {self.token[i]: i for t, i in vocabulary.items() if t not in special}
        return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is not None and self.LATIN.fullmatch(text):
            return self.fast.encode_ordinary(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids


class SideB:
    """A sentencepiece model that puts a space before its text."""

    BYTE = re.compile("<0x([0-9A-F]{2})>")

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.token = [bytes([int(m[1], 16)]) if (m := self.BYTE.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        self.length = np.array([len(t) for t in self.token], np.int64)
        text = [p for p in pieces if not self.BYTE.fullmatch(p)]
        #: no piece goes on past a space, or from a letter to a stop, so that words can be encoded by themselves
        self.by_word = not any(re.search(f".▁|[A-Za-zÀ-ÖØ-öø-ſ][{STOPS}]", p.lstrip("▁")) for p in text)

    def __call__(self, text: str) -> list[int]:
        """``text`` begins with the space that the model adds."""
        return self.model.encode(text[1:])


def joined(side: SideA | SideB, ids: list[int]) -> bytes:
    return b"".join(map(side.token.__getitem__, ids))


# ---- intervals -------------------------------------------------------------------------------


def coalesce(len_a: np.ndarray, len_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups and links of two rows of tokens that tile the same bytes, given by their byte lengths.

    Returns (group of each A token, group of each B token, A and B token number of each link)."""
    ends_a, ends_b = np.cumsum(len_a), np.cumsum(len_b)
    start = np.concatenate([ends_a - len_a, ends_b - len_b])
    end = np.concatenate([ends_a, ends_b])
    order = np.lexsort((end, start))
    start, end = start[order], end[order]
    reach = np.maximum.accumulate(end)
    group = np.empty(len(start), np.int64)
    group[order] = np.cumsum(np.concatenate([[True], start[1:] >= reach[:-1]])) - 1 if len(start) else 0
    group_a, group_b = group[: len(len_a)], group[len(len_a) :]
    # overlaps: B tokens from the first that ends past an A token's start to the last that starts before its end
    first = np.searchsorted(ends_b, ends_a - len_a, "right")
    past = np.searchsorted(ends_b - len_b, ends_a, "left")
    n = past - first
    link_a = np.repeat(np.arange(len(len_a)), n)
    link_b = np.arange(len(link_a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    return group_a, group_b, link_a, link_b


#: what a stretch of text adds to its document: A tokens, B tokens, groups, linked pairs (uint32), groups as text
Stretch = tuple[int, int, int, bytes, str]


def aligned(a: SideA, b: SideB, ids_a: list[int], ids_b: list[int], cuts: np.ndarray) -> list[Stretch]:
    """Stretches of a text between the byte offsets ``cuts`` (0 first), at which tokens of both sides end."""
    A, B = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
    len_a, len_b = a.length[A], b.length[B]
    group_a, group_b, link_a, link_b = coalesce(len_a, len_b)
    pairs = (A[link_a] << 16 | B[link_b]).astype(np.uint32).tobytes()
    n = int(group_a[-1]) + 1
    numbers = np.arange(n + 1)
    first_a, first_b = np.searchsorted(group_a, numbers).tolist(), np.searchsorted(group_b, numbers).tolist()
    text_a, text_b = list(map(str, ids_a)), list(map(str, ids_b))
    groups = [
        f"{','.join(text_a[p:q])}|{','.join(text_b[r:s])}" for p, q, r, s in zip(first_a, first_a[1:], first_b, first_b[1:])
    ]
    # where each stretch's tokens, groups and links begin
    at_a = np.searchsorted(np.cumsum(len_a) - len_a, cuts)
    at_b = np.searchsorted(np.cumsum(len_b) - len_b, cuts)
    at_link = [*np.searchsorted(link_a, at_a).tolist(), len(link_a)]
    at_group = [*group_a[at_a].tolist(), n]
    at_a, at_b = [*at_a.tolist(), len(A)], [*at_b.tolist(), len(B)]
    return [
        (a1 - a0, b1 - b0, g1 - g0, pairs[4 * l0 : 4 * l1], ";".join(groups[g0:g1]))
        for a0, a1, b0, b1, g0, g1, l0, l1 in zip(
            at_a, at_a[1:], at_b, at_b[1:], at_group, at_group[1:], at_link, at_link[1:]
        )
    ]


class Aligner:
    """Aligns texts, stretch by stretch. ``memory`` bounds the stretches that are remembered (some 350 bytes each), twice over."""

    def __init__(self, path_a: str, path_b: str, memory: int):
        self.a, self.b, self.memory = SideA(path_a), SideB(path_b), memory
        self.young: dict[str, Stretch | None] = {}
        self.old: dict[str, Stretch | None] = {}

    def one(self, text: str) -> Stretch | None:
        """A text that begins with a space, by itself; None if a side does not reproduce it."""
        ids_a, ids_b, data = self.a(text), self.b(text), text.encode()
        if not data or joined(self.a, ids_a) != data or joined(self.b, ids_b) != data:
            return None
        return aligned(self.a, self.b, ids_a, ids_b, np.zeros(1, np.int64))[0]

    def many(self, stretches: list[str], after: str) -> list[Stretch | None]:
        """Plain stretches, each put behind ``after`` and all encoded together; None where a side does not reproduce one."""
        text = "".join([after + s for s in stretches])
        ids_a, ids_b, data = self.a(text), self.b(text), text.encode()
        if joined(self.a, ids_a) != data or joined(self.b, ids_b) != data:
            half = len(stretches) // 2
            return self.many(stretches[:half], after) + self.many(stretches[half:], after) if half else [None]
        if not after:
            sizes = np.array([len(s.encode()) for s in stretches], np.int64)
            return aligned(self.a, self.b, ids_a, ids_b, np.cumsum(sizes) - sizes)
        sizes = np.array([n for s in stretches for n in (len(after), len(s.encode()))], np.int64)
        return aligned(self.a, self.b, ids_a, ids_b, np.cumsum(sizes) - sizes)[1::2]

    def learn(self, wanted: set[str], at_once: int = 2_000) -> dict[str, Stretch | None]:
        """The new ones of the stretches; short ones are remembered, in two generations."""
        new = wanted - self.young.keys()
        if len(self.young) + len(new) > self.memory:
            self.old, self.young, new = self.young, {}, wanted
        known: dict[str, Stretch | None] = {}
        plain: dict[str, list[str]] = {"": [], " a": []}
        for s in new:
            if s in self.old:
                self.young[s] = self.old[s]
            elif PLAIN.fullmatch(s):
                plain[""].append(s)
            elif AFTER.fullmatch(s):
                plain[" a"].append(s)
            else:  # white space at an edge; behind a letter it cannot be told apart from its word
                known[s] = self.one(s) if s[0] == " " else None
        for after, stretches in plain.items():
            for k in range(0, len(stretches), at_once):
                some = stretches[k : k + at_once]
                known.update(zip(some, self.many(some, after)))
        self.young.update((s, x) for s, x in known.items() if len(s) <= LONG)
        return known

    def __call__(self, texts: list[str | None]) -> list[list[Stretch]]:
        """The stretches of each text; none for texts without tokens."""
        cut = [(CUT.split(" " + t) if self.b.by_word else [" " + t]) if t else [] for t in texts]
        wanted: set[str] = set()
        wanted.update(*cut)
        known = self.learn(wanted)
        out = []
        for stretches in cut:
            found = [known[s] if s in known else self.young[s] for s in stretches]
            if None in found:
                whole = self.one("".join(stretches))
                found = [whole] if whole else []
            out.append(found)
        return out


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str, memory: int) -> Aligner:
    """A worker's aligner: it outlives a task, so that later ones need not learn again."""
    return Aligner(path_a, path_b, memory)


# ---- documents -------------------------------------------------------------------------------

_DOC = {
    "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(),
    "pairs": pa.list_(pa.int32()), "times": pa.list_(pa.int32()),
}


def align(docs: DataFrame, key: str, text: str, path_a: str, path_b: str, memory: int = 300_000) -> DataFrame:
    """One row a document: key, n_a, n_b, n_groups, n_links, groups_sha256, and its distinct linked id
    pairs (``pairs``: the 32 bits of A id * 65536 + B id) with how often they are linked (``times``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align_texts = aligner(path_a, path_b, memory)
        for batch in batches:
            columns: dict[str, list] = {name: [] for name in _DOC}
            for found in align_texts(batch.column(1).to_pylist()):
                n_a, n_b, n_groups, linked, groups = zip(*found) if found else ((), (), (), (), ())
                linked = np.frombuffer(b"".join(linked), np.uint32)
                pairs, times = np.unique(linked, return_counts=True)
                columns["n_a"].append(sum(n_a))
                columns["n_b"].append(sum(n_b))
                columns["n_groups"].append(sum(n_groups))
                columns["n_links"].append(len(linked))
                columns["groups_sha256"].append(sha256(";".join(groups).encode()).hexdigest() if found else "")
                columns["pairs"].append(pairs.view(np.int32))
                columns["times"].append(times.astype(np.int32))
            arrays = [pa.array(columns[name], kind) for name, kind in _DOC.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["key", *_DOC])

    narrow = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = narrow.schema["key"].dataType.simpleString()
    return narrow.mapInArrow(
        run,
        f"key {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<int>",
    ).withColumnRenamed("key", key)


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n, best): documents that hold each pair, and whether that is the most of any pair of its A id."""
    counts = found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = store(counts.withColumn("pair", F.col("pair").cast("long").bitwiseAND(0xFFFFFFFF)), "pairs")
    a = lambda: F.shiftright("pair", 16)
    # one row an A id: the vocabulary bounds it
    most = broadcast_within(counts.groupBy(a().alias("a")).agg(F.max("n").alias("most")), 1_000_000)
    return counts.join(most, a() == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def split(counts: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """(head, tail): at most ``most`` of the pairs, those of the most documents, and the others if there are any."""
    if counts.count() <= most:
        return counts, None
    power = F.floor(F.log2("n")).cast("int")
    sizes = {r["power"]: r["size"] for r in counts.groupBy(power.alias("power")).agg(F.count("*").alias("size")).collect()}
    least, held = 0, 0
    for p in sorted(sizes, reverse=True):
        held += sizes[p]
        if held > most:
            least = p + 1
            break
    return counts.filter(power >= least), counts.filter(power < least)


def summed(found: DataFrame, counts: DataFrame, gathered: int = GATHERED) -> DataFrame:
    """``found`` (with a row number ``row``) with n_best and count_sum of its links."""
    head, tail = split(counts, gathered)
    rows = head.toArrow()
    pair, n, best = rows["pair"].to_numpy().astype(np.uint32), rows["n"].to_numpy(), rows["best"].to_numpy(zero_copy_only=False)
    order = np.argsort(pair)
    table = found.sparkSession.sparkContext.broadcast((pair[order], n[order], best[order]))
    partly = tail is not None
    kept = [c for c in found.columns if c not in ("row", "pairs", "times")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = table.value
        for batch in batches:
            lists, times = batch.column(1), batch.column(2).flatten().to_numpy().astype(np.int64)
            here = lists.flatten().to_numpy().view(np.uint32)
            doc = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            at = np.searchsorted(pair, here)
            at[at == len(pair)] = 0
            known = pair[at] == here if len(pair) else np.zeros(len(here), bool)
            at, of, often = at[known], doc[known], times[known]
            n_best, total = np.zeros(len(lists), np.int64), np.zeros(len(lists), np.int64)
            np.add.at(n_best, of, often * best[at])
            np.add.at(total, of, often * n[at])
            columns = [batch.column(0), *batch.columns[3:], pa.array(n_best), pa.array(total)]
            names = ["row", *kept, "n_best", "count_sum"]
            if partly:
                ends = np.cumsum(np.bincount(doc[~known], minlength=len(lists)))
                offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
                columns += [pa.ListArray.from_arrays(offsets, pa.array(x[~known].astype(np.int64))) for x in (here, times)]
                names += ["rare", "often"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    narrow = found.select("row", "pairs", "times", *kept)
    schema = ", ".join(f"`{c}` {narrow.schema[c].dataType.simpleString()}" for c in ("row", *kept)) + ", n_best long, count_sum long"
    sums = narrow.mapInArrow(run, schema + (", rare array<long>, often array<long>" if partly else ""))
    if not partly:
        return sums.drop("row")
    sums = store(sums, "pair-sums")
    each = sums.select("row", F.explode(F.arrays_zip("rare", "often")).alias("g")).select("row", F.col("g.rare").alias("pair"), "g.often")
    each = each.join(tail, "pair").select("row", F.when(F.col("best"), F.col("often")).alias("b"), (F.col("often") * F.col("n")).alias("c"))
    more = each.groupBy("row").agg(F.sum("b").alias("b"), F.sum("c").alias("c"))
    zero = F.lit(0).cast("long")
    return sums.join(more, "row", "left").select(
        *kept, (F.col("n_best") + F.coalesce("b", zero)).alias("n_best"), (F.col("count_sum") + F.coalesce("c", zero)).alias("count_sum")
    )


def report(
    docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", gathered: int = GATHERED
) -> DataFrame:
    """One row a document: key, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum."""
    found = align(docs, key, text, path_a, path_b)
    found = store(found.withColumn("row", F.monotonically_increasing_id()), "alignment")
    counts = pair_counts(found)
    return summed(found, store(counts, "pair-counts"), gathered)
