"""SimHash near-duplicates by tiled exact comparison (operator 3).

Fingerprints are made inside each row (numpy, one vote a shingle and bit) and reduced to the distinct
ones. The comparison is exact: fingerprints within ``radius`` bits agree on at least one of
``radius + 1`` blocks of bits, so each fingerprint stands in one bucket for each block, and
only fingerprints of a bucket meet. Inside a bucket they are ordered by population count and cut into tiles;
two tiles whose population counts differ by more than the radius are skipped, the others are
compared by numpy exclusive-or and bit counts. A bucket above ``tile_rows`` is split into tiles
over many tasks. Each task reduces its pairs to a spanning forest, so a group of k close fingerprints
gives fewer than k links, and the links meet in Spark as connected components (large and small
stars). Exact copies share one fingerprint and are never paired.

Cases: a null text counts as empty; texts without a shingle have fingerprint 0 and link like any other;
the component id is the smallest non-null key of the component (null if there is none); repeated rows
are returned each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from sitelens.llm.common import broadcast_within, store

SEED = 42
TILE = 256


def fingerprint(text: bytes, words: int = 3) -> int:
    """64-bit SimHash of a UTF-8 text: XXH64 of its shingles of ``words`` words (fewer words: of the whole
    sequence), a bit is set if over half of them set it. ``bytes.lower`` folds A-Z only and
    ``bytes.split`` cuts at ASCII white space only."""
    w = text.lower().split()
    if not w:
        return 0
    if len(w) <= words:
        return xxh64_intdigest(b" ".join(w), SEED)
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words))))
    h = np.array([xxh64_intdigest(s, SEED) for s in shingles], np.uint64)
    votes = np.zeros(64, np.int64)
    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    for part in range(0, len(bits), 255):  # 255 votes fit a byte, which keeps the sums narrow
        votes += np.add.reduce(bits[part : part + 255], axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * votes > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """key, fp (the 64 bits as a long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t or b"", words) for t in batch.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["key", "fp"])

    narrow = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"key {narrow.schema['key'].dataType.simpleString()}, fp long")


# ---- comparison ------------------------------------------------------------------------------


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two tiles with at most ``radius`` differing bits."""
    return np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)


def compare(a: np.ndarray, b: np.ndarray | None, radius: int, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """All close pairs of the fingerprints of ``a`` (or between ``a`` and ``b``), tile by tile in
    the order of population counts; tile pairs whose counts lie further apart than the radius are skipped."""
    a = a[np.argsort(np.bitwise_count(a), kind="stable")]
    b, own = (a, True) if b is None else (b[np.argsort(np.bitwise_count(b), kind="stable")], False)
    ca, cb = np.bitwise_count(a).astype(int), np.bitwise_count(b).astype(int)
    left, right = [], []
    for i in range(0, len(a), tile):
        x, low, high = a[i : i + tile], ca[i], ca[min(i + tile, len(a)) - 1]
        for j in range(i if own else 0, len(b), tile):
            last = cb[min(j + tile, len(b)) - 1]
            if cb[j] - high > radius:
                break
            if low - last > radius:
                continue
            p, q = close_pairs(x, b[j : j + tile], radius)
            if own and i == j:
                p, q = p[p < q], q[p < q]
            left.append(x[p])
            right.append(b[j : j + tile][q])
    if not left:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(left), np.concatenate(right)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the connected groups of the pairs, roots left out: fewer links than nodes."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    far = root != np.arange(len(nodes))
    return nodes[far], nodes[root[far]]


def _links(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    none = np.zeros(0, np.uint64)
    node, root = forest(np.concatenate([none, *a]), np.concatenate([none, *b]))
    return pa.record_batch({"a": node.view(np.int64), "b": root.view(np.int64)})


def _compare_sorted(radius: int):
    """Rows (block, part, fp) sorted by bucket -> links. A bucket may go on in the next batch: its
    rows so far are carried along (a bucket here has at most ``tile_rows`` rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            block, part, fp = (np.concatenate([r, c.to_numpy(zero_copy_only=False)]) for r, c in zip(rest, batch.columns))
            edge = np.flatnonzero((block[1:] != block[:-1]) | (part[1:] != part[:-1])) + 1
            cut = edge[-1] if len(edge) else 0
            rest = [block[cut:], part[cut:], fp[cut:]]
            if cut:
                yield buckets(fp[:cut], edge)
        if len(rest[2]):
            yield buckets(rest[2], np.array([len(rest[2])]))

    def buckets(fp: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        fp, starts, left, right = fp.view(np.uint64), np.concatenate([[0], ends[:-1]]), [], []
        size = ends - starts
        number = np.repeat(np.arange(len(ends)), size)
        small = size[number] <= 16  # most buckets: neighbours at each distance, all buckets at once
        fs, ns = fp[small], number[small]
        for step in range(1, min(16, len(fs))):
            same = (ns[step:] == ns[:-step]) & (np.bitwise_count(fs[step:] ^ fs[:-step]) <= radius)
            left.append(fs[:-step][same])
            right.append(fs[step:][same])
        for k in np.flatnonzero(size > 16):
            p, q = compare(fp[starts[k] : ends[k]], None, radius)
            left.append(p)
            right.append(q)
        return _links(left, right)

    return run


def close_links(fps: DataFrame, radius: int, tile_rows: int = 4_096) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` within ``radius`` bits."""
    blocks = radius + 1
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    part = lambda i: F.expr(f"shiftrightunsigned(fp, {cuts[i]}) & {(1 << (cuts[i + 1] - cuts[i])) - 1}L")
    dealt = fps.select("fp", F.posexplode(F.array(*map(part, range(blocks)))).alias("block", "part"))
    sizes = dealt.groupBy("block", "part").count().filter(F.col("count") > tile_rows)
    heavy = store(sizes.select(F.col("block").alias("hb"), F.col("part").alias("hp")), "heavy-buckets")
    is_heavy = (F.col("block") == F.col("hb")) & (F.col("part") == F.col("hp"))
    few = broadcast_within(heavy, 1_000_000)
    light = dealt.join(few, is_heavy, "left_anti").select("block", F.col("part"), "fp")
    light = light.repartition("block", "part").sortWithinPartitions("block", "part")
    links = light.mapInArrow(_compare_sorted(radius), "a long, b long")
    if heavy.limit(1).count() == 0:
        return links
    return links.unionByName(_heavy_links(dealt.join(few, is_heavy, "left_semi"), radius, tile_rows))


def _heavy_links(dealt: DataFrame, radius: int, tile_rows: int) -> DataFrame:
    """Buckets too large for one task: tiles of one population count and at most about ``tile_rows``
    fingerprints; one task for each pair of tiles of a bucket whose counts are within the radius."""
    ones = dealt.withColumn("ones", F.expr("bit_count(fp)"))
    tiles = ones.groupBy("block", "part", "ones").agg(F.ceil(F.count("*") / tile_rows).alias("subs"))
    tiles = store(tiles, "tiles")
    named = (
        ones.join(tiles, ["block", "part", "ones"])
        .withColumn("sub", F.pmod(F.xxhash64("fp"), F.col("subs")))
        .drop("subs")
    )
    each = tiles.select("block", "part", "ones", F.explode(F.expr("sequence(0L, subs - 1)")).alias("sub"))
    other = each.select("block", "part", F.col("ones").alias("ones2"), F.col("sub").alias("sub2"))
    met = each.join(other, ["block", "part"]).filter(
        (F.col("ones2") - F.col("ones")).between(0, radius) & ((F.col("ones2") > F.col("ones")) | (F.col("sub2") >= F.col("sub")))
    )
    at = ["block", "part", "ones", "sub", "ones2", "sub2"]
    lefts = named.join(met, ["block", "part", "ones", "sub"]).select(*at, F.lit(0).alias("side"), "fp")
    right = named.withColumnsRenamed({"ones": "ones2", "sub": "sub2"}).join(
        met.filter("ones != ones2 OR sub != sub2"), ["block", "part", "ones2", "sub2"]
    )
    rows = lefts.unionByName(right.select(*at, F.lit(1).alias("side"), "fp"))

    def run(table: pa.Table) -> pa.Table:
        fp, side = table["fp"].to_numpy().view(np.uint64), table["side"].to_numpy()
        own = table["ones"][0] == table["ones2"][0] and table["sub"][0] == table["sub2"][0]
        p, q = compare(fp[side == 0], None if own else fp[side == 1], radius)
        return pa.Table.from_batches([_links([p], [q])])

    return rows.groupBy(*at).applyInArrow(run, "a long, b long")


# ---- components ------------------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for every node of the links (a, b).

    Alternating large and small stars: each round hangs all neighbours of a node below the smallest of
    them. Links never grow in number; a hub is one key of a plain join, which Spark splits."""
    edges = store(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "links")
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).withColumn("m", F.least("w", "m"))
        large = both.filter("v > u").join(low, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = store(large.distinct(), "large-star")
        low = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        small = large.join(low, F.col("u") == F.col("w")).select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")
        )
        edges = store(small.select("e.u", "e.v").filter("u != v").distinct(), "small-star")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        state = now


def link(docs: DataFrame, key: str, text: str, words: int, radius: int) -> DataFrame:
    """key, fp, component_id for every row of ``docs``."""
    prints = store(fingerprints(docs, key, text, words), "fingerprints")
    fps = store(prints.groupBy("fp").agg(F.min("key").alias("first")), "distinct-fingerprints")
    trees = components(close_links(fps.select("fp"), radius))
    rooted = fps.join(trees, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.select(F.col("fp").alias("of"), "root").join(smallest, "root").select("of", "component_id")
    named = store(named, "components")
    return prints.join(named, F.col("fp") == F.col("of")).select(F.col("key").alias(key), "fp", "component_id")
