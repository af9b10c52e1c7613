"""Merkle manifest of a dataset, built and proved by time-forward processing (operator 12).

A leaf is the hash of a row's fields. The leaves of a group (a source) ascend by key; while several nodes remain,
every ``ARITY`` consecutive ones become their hash. The last one is the group's subroot, and the subroots, by group,
become the root in the same way.

Every node has a label, (group, last leaf below it, level), in whose order children precede their parents.
Rows are placed by a distributed sort and cut into segments of ``ARITY ** levels`` consecutive nodes of a group, so a
group of any size spreads over all tasks. A task reads its segments as a sorted stream (Spark's external sort) and
keeps a priority queue of messages, ordered by the label of their receiver:

* forward: a node sends its digest to its parent, which is due when the stream has passed its last leaf;
* reversed: in falling label order a parent sends each child the part of the proof that lies above it.

What a segment sends upward is the next round's input, ``ARITY ** levels`` times smaller. The queue holds
at most ``ARITY`` messages a level, whatever the size of the data.

Cases: a null field is written ``-``; a null group is a group of its own and comes first, an empty one is another; a null
key comes first; equal keys ascend by leaf; repeated rows are separate, equal leaves; a row that is alone in its group
has no siblings there; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from hashlib import sha256
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.window import Window

from sitelens.llm.common import broadcast_within, store

ARITY = 16
LEVELS = 3  # levels of a segment, unless a caller says otherwise: 4096 nodes
DIGEST = 32  # bytes


def field(col: Column | str) -> Column:
    """A value as bytes of its own length: ``-`` if null, else UTF-8 byte count, colon, value."""
    text = (F.col(col) if isinstance(col, str) else col).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*cols: Column | str) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, cols)), 256))


# ---- places ----------------------------------------------------------------------------------


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``place``: each row's number (from 0) in the order of the columns.

    Rows are sorted by range; repeated rows of the same order are told apart by a number of their own, so
    that they too spread over the ranges. The numbers of rows in the ranges are all that is gathered."""
    df = store(df.withColumn("_tie", F.monotonically_increasing_id()), "unordered")
    by = [*(F.col(c).asc_nulls_first() for c in order), F.xxhash64("_tie"), F.col("_tie")]
    spread = df.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie")
    spread = spread.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    spread = store(spread, "ordered")
    sizes = spread.groupBy("_part").agg(F.count("*").alias("rows"))
    # one row a range: a number that the session's settings bound
    before = F.coalesce(F.sum("rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    return spread.join(F.broadcast(offsets), "_part").withColumn("place", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


# ---- streams of labelled rows ----------------------------------------------------------------


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema, at_once: int = 2_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == at_once:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _swept(df: DataFrame, order: list[Column], sweep: Callable, kinds: dict[str, pa.DataType]) -> DataFrame:
    """Deal ``df`` by segment, sort each task's rows by label and send them through ``sweep``."""
    schema = pa.schema(list(kinds.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(sweep(_rows(batches)), schema)

    dealt = df.repartition("grp", "segment").sortWithinPartitions("grp", "segment", *order)
    return dealt.mapInArrow(run, from_arrow_schema(schema))


# ---- forward ---------------------------------------------------------------------------------


def node_hash(run: bytes) -> bytes:
    """H of a run of digests: sha256 of their hexadecimal texts."""
    return sha256(run.hex().encode()).digest()


def forward(rows: Iterator[tuple], levels: int = LEVELS) -> Iterator[tuple]:
    """Digests of a stream (grp, segment, idx, size, digest) go to their parents. ``size``: number of nodes of the
    group on this level. Yields (grp, segment, level, idx, size, digest, run) for each node above, ``run`` being its
    children's digests."""
    queue: list[tuple] = []  # (grp, last leaf below the receiver, level, idx, child, digest, segment, size)

    def send(grp, segment, level, idx, size, digest):
        """Address a node's parent, unless the node ends its segment or is all that remains."""
        if level < levels and size > 1:
            parent = idx // ARITY
            last = (parent + 1) * ARITY ** (level + 1) - 1
            heappush(queue, (grp, last, level + 1, parent, idx, digest, segment, size))

    def due(grp, idx):
        """Nodes all of whose leaves stand before leaf ``idx`` of ``grp`` (None: all)."""
        while queue and (grp is None or queue[0][:2] < (grp, idx)):
            g, last, level, node, _, digest, segment, size = heappop(queue)
            run = [digest]
            while queue and queue[0][:4] == (g, last, level, node):
                run.append(heappop(queue)[5])
            run, above = b"".join(run), -(-size // ARITY)
            digest = node_hash(run)
            yield g, segment, level, node, above, digest, run
            send(g, segment, level, node, above, digest)

    for grp, segment, idx, size, digest in rows:
        yield from due(grp, idx)
        send(grp, segment, 0, idx, size, digest)
    yield from due(None, None)


_NODE = {
    "grp": pa.int64(), "segment": pa.int64(), "level": pa.int32(), "idx": pa.int64(), "size": pa.int64(),
    "digest": pa.binary(), "run": pa.binary(),
}


def grow(leaves: DataFrame, levels: int = LEVELS) -> tuple[list[DataFrame], DataFrame]:
    """(rounds, roots) of leaves (grp, idx, size, digest): each round's nodes, and (grp, digest) of every group's last."""
    each = ARITY**levels
    most = leaves.agg(F.max("size")).first()[0] or 0
    roots = leaves.filter("size = 1").select("grp", "digest")
    rounds, nodes = [], leaves.filter("size > 1")
    while most > 1:
        dealt = nodes.select("grp", F.floor(F.col("idx") / each).alias("segment"), "idx", "size", "digest")
        above = store(_swept(dealt, [F.col("idx")], partial(forward, levels=levels), _NODE), f"manifest{len(rounds)}")
        rounds.append(above)
        roots = roots.unionByName(above.filter("size = 1").select("grp", "digest"))
        nodes = above.filter((F.col("level") == levels) & (F.col("size") > 1)).select("grp", "idx", "size", "digest")
        most = -(-most // each)
    return rounds, roots


# ---- reversed --------------------------------------------------------------------------------
# A proof is kept as bytes, lowest level first: for each run the own position, the number of digests, the others.


def step(run: bytes, position: int) -> bytes:
    """The part of a proof that a run gives its member at ``position``."""
    at = position * DIGEST
    return bytes((position, len(run) // DIGEST)) + run[:at] + run[at + DIGEST :]


def steps(proof: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(siblings before, siblings after) of each level of a proof."""
    at = 0
    while at < len(proof):
        position, n = proof[at], proof[at + 1]
        middle, end = at + 2 + position * DIGEST, at + 2 + (n - 1) * DIGEST
        yield proof[at + 2 : middle], proof[middle:end]
        at = end


def fold(digest: bytes, proof: bytes) -> bytes:
    """The root that follows from a leaf and its proof."""
    for before, after in steps(proof):
        digest = node_hash(before + digest + after)
    return digest


def siblings(proof: bytes) -> bytes:
    return b"".join(before + after for before, after in steps(proof))


def reversed_sweep(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Proofs of a stream (grp, segment, idx, level, run, proof, ...) in falling label order: first what the
    segment's highest node gets from above (``proof``), then inner nodes (``run``), then leaves (neither).
    Yields each leaf's row with its proof."""
    queue: list[tuple] = []  # (-last leaf below the receiver, -level, idx, proof) of one segment
    now = None
    for grp, segment, idx, level, run, proof, *rest in rows:
        if now != (grp, segment):
            now, queue = (grp, segment), []
        if proof is not None:  # the highest node is the first to come
            heappush(queue, (float("-inf"), 0, 0, proof))
            continue
        above = heappop(queue)[3]
        if run is None:
            yield grp, idx, above, *rest
            continue
        below = level - 1
        for position in range(len(run) // DIGEST):
            child = idx * ARITY + position
            heappush(queue, (-((child + 1) * ARITY**below - 1), -below, child, step(run, position) + above))


def descend(rounds: list[DataFrame], leaves: DataFrame, proofs: DataFrame, payload: dict[str, pa.DataType], levels: int = LEVELS) -> DataFrame:
    """(grp, idx, proof, payload) of every leaf. ``proofs`` (grp, proof): what each group's last node gets from above.
    ``leaves`` (grp, idx, size, payload)."""
    each = ARITY**levels
    nothing = {k: F.lit(None) for k in payload}
    down = leaves.filter("size = 1").join(proofs, "grp").select("grp", "idx", "proof", *payload)
    for number in reversed(range(len(rounds))):
        last = number == 0
        nodes = rounds[number]
        columns = payload if last else {}
        # a group that ends in this round takes its proof from above, the others from the round before
        tops = nodes.filter("size = 1").select("grp", "segment").join(proofs, "grp")
        if number + 1 < len(rounds):
            tops = tops.unionByName(upper.select("grp", F.col("idx").alias("segment"), "proof"))
        if last:
            low = leaves.filter("size > 1")
        else:
            low = rounds[number - 1].filter((F.col("level") == levels) & (F.col("size") > 1))
        low = low.select("grp", F.floor(F.col("idx") / each).alias("segment"), "idx", *columns)
        none, blank = F.lit(None).cast("binary"), {k: nothing[k].cast(low.schema[k].dataType) for k in columns}
        order = ["grp", "segment", "idx", "level", "run", "proof", *columns]
        stream = (
            tops.withColumns({"idx": F.lit(0).cast("long"), "level": F.lit(levels + 1), "run": none, **blank}).select(*order)
            .unionByName(nodes.withColumns({"proof": none, **blank}).select(*order))
            .unionByName(low.withColumns({"level": F.lit(0), "run": none, "proof": none}).select(*order))
        )
        # last leaf below a node, falling; a parent stands before its last child
        place = F.when(F.col("proof").isNotNull(), F.lit((1 << 63) - 1)).otherwise(
            (F.col("idx") + 1) * F.pow(F.lit(ARITY), F.col("level")).cast("long")
        )
        kinds = {"grp": pa.int64(), "idx": pa.int64(), "proof": pa.binary(), **columns}
        upper = _swept(stream, [place.desc(), F.col("level").desc()], reversed_sweep, kinds)
        if last:
            return down.unionByName(upper.select(*down.columns))
        upper = store(upper, f"proofs{number}")
    return down


# ---- manifest --------------------------------------------------------------------------------


def manifest(rows: DataFrame, key: str, group: str, leaf: str, given: str, levels: int = LEVELS) -> DataFrame:
    """One row a row of ``rows``: key, leaf, subroot, root, proof (bytes) and folded (the root that follows from the digest
    in ``given`` and the proof). ``leaf`` and ``given`` hold digests (binary)."""
    named = rows.select(F.col(key).alias("key"), F.col(group).cast("string").alias("name"), F.col(leaf).alias("digest"), F.col(given).alias("given"))
    placed = numbered(named, ["name", "key", "digest"])
    groups = placed.groupBy("name").agg(F.min("place").alias("first"), F.count("*").alias("size"))
    groups = store(numbered(groups, ["name"]).withColumnRenamed("place", "grp"), "groups")
    n_groups = groups.count()
    own = broadcast_within(groups.select(F.col("name").alias("of"), "grp", "first", "size"), 1_000_000)
    leaves = placed.join(own, F.col("name").eqNullSafe(F.col("of")))
    leaves = store(leaves.select("grp", (F.col("place") - F.col("first")).alias("idx"), "size", "key", "digest", "given"), "leaves")
    rounds, subroots = grow(leaves.select("grp", "idx", "size", "digest"), levels)
    subroots = store(subroots, "subroots")

    tops = subroots.select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("idx"), F.lit(n_groups).cast("long").alias("size"), "digest")
    top_rounds, roots = grow(tops, levels)
    root = roots.first()
    if root is None:
        return _result(leaves.withColumns({"subroot": F.col("digest"), "root": F.col("digest"), "proof": F.lit(b"")}), key)
    root = F.lit(bytes(root["digest"]))
    start = rows.sparkSession.range(1).select(F.col("id").alias("grp"), F.lit(b"").alias("proof"))
    of_group = descend(top_rounds, tops.drop("digest"), start, {}, levels)
    of_group = store(of_group.select(F.col("idx").alias("grp"), "proof"), "group-proofs")
    payload = {f.name: f.type for f in to_arrow_schema(leaves.select("key", "digest", "given").schema)}
    proved = descend(rounds, leaves, of_group, payload, levels)
    ends = broadcast_within(subroots.select("grp", F.col("digest").alias("subroot")), 1_000_000)
    return _result(proved.join(ends, "grp").withColumn("root", root), key)


def _result(proved: DataFrame, key: str) -> DataFrame:
    """Proof texts and folded roots, in the rows' own tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            proofs, given = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            hashes = [sha256(siblings(p).hex().encode()).hexdigest() for p in proofs]
            folded = [fold(d, p).hex() for d, p in zip(given, proofs)]
            columns = [*batch.columns[:4], pa.array(hashes, pa.string()), pa.array(folded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "leaf", "subroot", "root", "proof_sha256", "folded_root"])

    text = lambda c: F.lower(F.hex(c)).alias(c)
    narrow = proved.select("key", text("digest"), text("subroot"), text("root"), "proof", "given")
    kind = narrow.schema["key"].dataType.simpleString()
    out = narrow.mapInArrow(run, f"key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return out.withColumn("verified", F.col("folded_root") == F.col("root")).withColumnRenamed("key", key)
