"""Best-fit packing of token pieces with swap-based local search (operator 8).

Texts are tokenized in their own rows and cut into pieces of at most ``capacity`` tokens. Full pieces
are sequences by themselves. The others are dealt to groups of about ``group_rows`` pieces, and
each group is packed in one task: best fit by falling length, then local search between the underfull bins
(moves, one-for-one and two-for-one exchanges that increase the sum of squared fills) until the
emptiest bins dissolve. What still lies in underfull bins is dealt to fewer groups and packed again,
until one group is left; so groups cost next to nothing and no task holds more than a group.

Cases: a null text counts as empty, and a document without tokens is its end token alone; a null key is
kept; repeated rows are separate documents; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import byte_level, store

#: Control characters that ``str.split`` takes for white space and the tokenizer does not.
_NOT_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")


class WordIds:
    """Token ids of texts as little-endian uint32 bytes, remembered by word.

    The tokenizer never joins tokens across white space, so a text's ids are the ids of its words in turn; and it
    cuts words into runs of letters, single digits and runs of signs before it looks for tokens. New plain words (ASCII and
    Latin letters) are cut here the same way, many at once, and merged by ``tiktoken`` with the same vocabulary: a sign
    that plain words never hold (``MARK``) ends each run and stands for the end-of-word mark, whose merges come first.
    Other words, texts with special tokens, and vocabularies built otherwise go through the tokenizer as they are.

    At most ``words`` words are young; when they are full they become the old ones, and the old ones that nobody asked
    for again are forgotten."""

    MARK = "\x7f"
    PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e ]*")
    RUN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017e]+|[0-9]| |[^ a-z0-9\u00df-\u00f6\u00f8-\u017e]+")

    def __init__(self, path: str, words: int = 450_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = words
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        # special tokens are found in the raw text, across word edges: such texts go through whole
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast, self.gap = self._marked()

    def _marked(self):
        """(encoder of marked runs, id of a marked space), or (None, 0) where the vocabulary does not allow it."""
        import tiktoken

        vocabulary = {t: i for t, i in self.tokenizer.get_vocab().items() if t not in self.special}
        merges = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in json.loads(self.tokenizer.to_str())["model"]["merges"]]
        byte_of = byte_level()
        ranks: dict[bytes, int] = {}
        for token, i in vocabulary.items():
            ends = token.endswith("</w>")
            stem = token[:-4] if ends else token
            if not all(c in byte_of for c in stem):
                return None, 0
            ranks.setdefault(bytes(byte_of[c] for c in stem) + self.MARK.encode() * ends, i)
        # single bytes, then single bytes that end a word, then merges in their order
        ordered = merges == sorted(merges) and merges[0] >= 512 and all(ranks.get(bytes([b]) + self.MARK.encode(), 512) < 512 for b in range(256))
        if not ordered or len(ranks) != len(vocabulary):
            return None, 0
        fast = tiktoken.Encoding("words", pat_str=f"[^{self.MARK}]+{self.MARK}", mergeable_ranks=ranks, special_tokens={})
        return fast, ranks[b" " + self.MARK.encode()]

    def direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _plain(self, some: list[str]) -> None:
        """Learn plain words."""
        ids = np.array(self.fast.encode_ordinary(self.MARK.join([*self.RUN.findall(" ".join(some).lower()), ""])), "<u4")
        ends = (np.flatnonzero(ids == self.gap) * 4).tolist()
        data = ids.tobytes()
        self.young.update((w, data[a:b]) for w, a, b in zip(some, [0, *[e + 4 for e in ends]], [*ends, len(data)]))

    def _learn(self, wanted: set[str], at_once: int = 5_000) -> None:
        """All of ``wanted`` are young after this call."""
        absent = wanted - self.young.keys()
        if absent and len(self.young) + len(absent) > self.size:
            self.old, self.young = self.young, {}
            absent = wanted
        if self.old:
            again = absent & self.old.keys()
            self.young.update((w, self.old[w]) for w in again)
            absent = absent - again
        new = list(absent)
        for k in range(0, len(new), at_once):
            some = new[k : k + at_once]
            if self.fast is not None and not self.PLAIN.fullmatch(" ".join(some)):
                odd = [w for w in some if not self.PLAIN.fullmatch(w)]
                some = [w for w in some if self.PLAIN.fullmatch(w)]
            else:
                odd, some = ([], some) if self.fast is not None else (some, [])
            for w in odd:
                self.young[w] = self.direct(w)
            if some:
                self._plain(some)

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text of a batch."""
        out: list[bytes | list[str]] = []
        wanted: set[str] = set()
        for text in texts:
            text = text or ""
            if any(c in text for c in _NOT_SPACE) or any(s in text for s in self.special):
                out.append(self.direct(text))
            else:
                words = text.split()
                wanted.update(words)
                out.append(words)
        self._learn(wanted)
        known = self.young.__getitem__
        return [x if isinstance(x, bytes) else b"".join(map(known, x)) for x in out]


@lru_cache(maxsize=1)
def word_ids(path: str, words: int) -> WordIds:
    """A worker's memory: it outlives a task, so that later ones need not learn again."""
    return WordIds(path, words)


def tokenize(
    docs: DataFrame, key: str, text: str, tokenizer: str, end_id: int, capacity: int, with_ids: bool = False, words: int = 450_000
) -> DataFrame:
    """One row a piece: key, piece, start, length, ids_crc32 and, on request, ``ids`` (array<int>).
    ``words`` bounds what a worker remembers (some 200 bytes each, twice)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = word_ids(tokenizer, words), struct.pack("<I", end_id)
        for batch in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, data in enumerate(ids_of(batch.column(1).to_pylist())):
                data += end
                for p, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(p)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            columns = [
                batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
            ]
            names = ["key", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    narrow = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = narrow.schema["key"].dataType.simpleString()
    more = ", ids array<int>" if with_ids else ""
    out = narrow.mapInArrow(run, f"key {kind}, piece int, start long, length long, ids_crc32 long{more}")
    return out.withColumnRenamed("key", key)


# ---- packing one group -----------------------------------------------------------------------


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins (lists of item numbers): longest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    at_free: dict[int, list[int]] = defaultdict(list)
    free_sizes = 0  # bit f is set if some bin has f tokens free
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[item]
        fitting = free_sizes >> need
        if fitting:
            free = need + (fitting & -fitting).bit_length() - 1
            b = at_free[free].pop()
            if not at_free[free]:
                free_sizes &= ~(1 << free)
            bins[b].append(item)
        else:
            free, b = capacity, len(bins)
            bins.append([item])
        if free > need:
            at_free[free - need].append(b)
            free_sizes |= 1 << (free - need)
    return bins


class Bin:
    """Items by length, and the lengths that one item or two items have, as bits."""

    def __init__(self, items: list[int], lengths: list[int]):
        self.by_length: dict[int, list[int]] = {}
        self.size, self.one, self._two = 0, 0, None
        for i in items:
            self.put(lengths[i], i)

    def put(self, length: int, item: int) -> None:
        self.by_length.setdefault(length, []).append(item)
        self.size += length
        self.one |= 1 << length
        self._two = None

    def take(self, length: int) -> int:
        held = self.by_length[length]
        item = held.pop()
        if not held:
            del self.by_length[length]
            self.one ^= 1 << length
        self.size -= length
        self._two = None
        return item

    @property
    def two(self) -> int:
        if self._two is None:
            self._two = 0
            for length, held in self.by_length.items():
                others = self.one if len(held) > 1 else self.one ^ (1 << length)
                self._two |= others << length
        return self._two

    def pair(self, total: int) -> tuple[int, int]:
        """Lengths of two items that have ``total`` together."""
        for length, held in self.by_length.items():
            other = total - length
            if other in self.by_length and (other != length or len(held) > 1):
                return length, other
        raise KeyError(total)

    def items(self) -> list[int]:
        return [i for held in self.by_length.values() for i in held]


def best_exchange(donor: Bin, receiver: Bin, free: int) -> tuple[int, tuple, tuple]:
    """(gain, lengths to give, lengths to take) that bring the receiver the most tokens, at most ``free``: a move, one
    for one, two for one or one for two; (0, (), ()) if none brings any. Lengths, not items, are searched, so
    the work is bounded by the distinct lengths, however many items the bins hold."""
    room = (1 << (free + 1)) - 2  # bits 1 to free
    gain, kind, at = (donor.one & room).bit_length() - 1, 0, 0
    for y in receiver.by_length:
        if gain == free:
            break
        found = ((donor.one >> y) & room).bit_length() - 1
        if found > gain:
            gain, kind, at = found, 1, y
        found = ((donor.two >> y) & room).bit_length() - 1
        if found > gain:
            gain, kind, at = found, 2, y
    if gain < free:
        for x in donor.by_length:  # two of the receiver's that are shorter than x, by as much as fits
            low = max(x - free, 0)
            fitting = receiver.two >> low
            total = low + (fitting & -fitting).bit_length() - 1
            if fitting and gain < x - total:
                gain, kind, at = x - total, 3, x
                if gain == free:
                    break
    if gain <= 0:
        return 0, (), ()
    if kind == 0:
        return gain, (gain,), ()
    if kind == 1:
        return gain, (gain + at,), (at,)
    if kind == 2:
        return gain, donor.pair(gain + at), (at,)
    return gain, (at,), receiver.pair(at - gain)


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Dissolve underfull bins: the emptiest bin gives its tokens to fuller ones by moves, one-for-one, two-for-one and
    one-for-two exchanges, each of which increases the sum of squared fills. A bin that can give nothing is settled, until
    some other bin has changed; the search ends when no bin can give anything to a fuller one."""
    held = [Bin(b, lengths) for b in bins]
    changed = [0] * len(held)  # when a bin was last changed
    settled = [-1] * len(held)  # when a bin was last found to give nothing
    clock, before = 0, -1
    while clock > before:
        before = clock
        under = sorted((b for b in range(len(held)) if 0 < held[b].size < capacity), key=lambda b: (-held[b].size, b))
        for d in reversed(under):  # the emptiest gives first
            start = -1
            while clock > start and 0 < held[d].size < capacity:
                start = clock
                for b in under:  # to the fullest that can take
                    # what has not changed since this bin was settled need not be tried again
                    if b != d and (changed[b] > settled[d] or changed[d] > settled[d]) and held[d].size <= held[b].size < capacity:
                        clock += _exchange(held, changed, clock + 1, d, b, capacity)
            settled[d] = clock
    return [h.items() for h in held if h.size]


def _exchange(held: list[Bin], changed: list[int], clock: int, d: int, b: int, capacity: int) -> bool:
    """The best exchange between donor d and receiver b, if there is one."""
    gain, give, take = best_exchange(held[d], held[b], capacity - held[b].size)
    if not gain:
        return False
    given, taken = [(n, held[d].take(n)) for n in give], [(n, held[b].take(n)) for n in take]
    for n, item in given:
        held[b].put(n, item)
    for n, item in taken:
        held[d].put(n, item)
    changed[d] = changed[b] = clock
    return True


def pack_lengths(lengths: list[int], capacity: int) -> list[list[int]]:
    return local_search(best_fit(lengths, capacity), lengths, capacity)


# ---- packing all -----------------------------------------------------------------------------


def pack(pieces: DataFrame, capacity: int, group_rows: int = 4_000) -> DataFrame:
    """``pieces`` (with ``length``) with ``sequence_id`` and ``offset``; offsets of a sequence follow each
    other from 0 without gaps. Columns are carried along, so pass narrow rows."""
    columns = pieces.columns
    held = store(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    full = held.filter(F.col("length") >= capacity).withColumns(
        {"sequence_id": -1 - F.col("_row"), "offset": F.lit(0).cast("long")}
    )
    done = [full.select(*columns, "sequence_id", "offset")]
    rest = held.filter(F.col("length") < capacity)
    n, level = rest.count(), 0
    while True:
        groups = -(-n // group_rows) or 1
        packed = store(_pack_groups(rest, capacity, groups, level), f"packed{level}")
        again = packed.filter("loose") if groups > 1 else None
        left = again.count() if again is not None else 0
        if left == 0 or left >= n:
            done.append(packed.select(*columns, "sequence_id", "offset"))
            break
        done.append(packed.filter("NOT loose").select(*columns, "sequence_id", "offset"))
        rest, n, level = again.drop("sequence_id", "offset", "loose"), left, level + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _pack_groups(rest: DataFrame, capacity: int, groups: int, level: int) -> DataFrame:
    """Pack each group of rows. ``loose``: the row lies in a bin that is not full to 99.5 percent.
    Groups come from a hash of the row number, so equal documents spread over all of them."""
    enough = int(0.995 * capacity)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_row", ignore_index=True)
        lengths = pdf["length"].tolist()
        sequence, offset, loose = (np.zeros(len(lengths), d) for d in (np.int64, np.int64, bool))
        group = int(pdf["_group"].iloc[0])
        for number, items in enumerate(pack_lengths(lengths, capacity)):
            at = 0
            for i in items:
                sequence[i], offset[i] = ((level * (1 << 34) + group) << 24) + number, at
                at += lengths[i]
            loose[items] = at < enough
        return pdf.drop(columns="_group").assign(sequence_id=sequence, offset=offset, loose=loose)

    schema = rest.schema.add("sequence_id", "long").add("offset", "long").add("loose", "boolean")
    dealt = rest.withColumn("_group", F.pmod(F.xxhash64("_row", F.lit(level)), F.lit(groups)))
    return dealt.groupBy("_group").applyInPandas(run, schema)
