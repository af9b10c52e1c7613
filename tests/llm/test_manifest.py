"""The Merkle manifest, against a plain tree."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from sitelens.llm import merkle_manifest, queries
from sitelens.llm.common import prepare

from .test_text_operators import prose


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[k] for k in ("doc_id", "source", "lang", "n_chars", "text"))))


def tree(digests):
    """The root, and for each digest the runs it stands in with its places."""
    paths, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        runs = [digests[i : i + 16] for i in range(0, len(digests), 16)]
        for k, i in enumerate(at):
            paths[k].append((runs[i // 16], i % 16))
        at, digests = [i // 16 for i in at], [h(*run) for run in runs]
    return digests[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    subroots, members = [], []
    for name in sorted(groups, key=lambda s: (s is not None, (s or "").encode())):
        group = sorted(groups[name], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        subroot, paths = tree([leaf(r) for r in group])
        subroots.append(subroot)
        members.append((group, paths))
    out = []
    root, tops = tree(subroots) if subroots else ("", [])
    for (group, paths), subroot, top in zip(members, subroots, tops):
        for r, path in zip(group, paths):
            path = path + top
            others = "".join("".join(run[:i] + run[i + 1 :]) for run, i in path)
            text = r["text"]
            if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            folded = leaf({**r, "text": text})
            for run, i in path:
                folded = h(*run[:i], folded, *run[i + 1 :])
            out.append((r["doc_id"], leaf(r), subroot, root, h(others), folded, folded == root))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0] or 0, *map(str, r[1:])))


ROWS = [(i, prose(5 + i % 40, i), "en", f"s{i % 3}") for i in range(90)]
ROWS += [(i, "ONE Text", "de", "hot") for i in range(100, 500)] + [(7, "ONE Text", "de", "hot")] * 40
ROWS += [(900, None, None, None), (901, "", "en", ""), (None, "A", "en", None), (None, "A", "en", None), (902, "ÄB", "en", "\U0001f600")]
ROWS += [(903, "only", "en", "￮"), (904, prose(30_000, 3), "en", "s1"), (0, "ZERO", "en", "s0")]


def test_manifest_query(spark, documents, sf):
    folder = sf(documents=documents(ROWS))
    got = queries.QUERIES["op12_merkle_manifest"](spark, folder)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    rows = got.collect()
    want = brute([r.asDict() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()])
    assert ordered(rows) == ordered(want)
    assert {r["verified"] for r in rows} == {True, False}
    assert all(r["verified"] for r in rows if r["doc_id"] is None)


@pytest.mark.parametrize("levels", [1, 2])
def test_manifest_of_many_rounds(spark, documents, levels):
    """Segments of 16 or 256 nodes: several rounds, over a group cut into many segments."""
    docs = documents(ROWS)
    rows = docs.select("doc_id", "source", merkle_manifest.leaf_digest("doc_id", "source", "lang", "n_chars", "text").alias("d"))
    got = merkle_manifest.manifest(rows.withColumn("given", F.col("d")), "doc_id", "source", "d", "given", levels=levels).collect()
    want = brute([r.asDict() for r in docs.collect()])
    assert ordered(r[:5] for r in got) == ordered(r[:5] for r in want)
    assert all(r["verified"] for r in got)


@pytest.mark.parametrize("n", [0, 1, 16, 17])
def test_manifest_of_few_rows(spark, documents, n):
    """An empty table, a lone leaf (its own root), a full run and a run of one."""
    docs = documents([(i, f"t{i}", "en", "s") for i in range(n)]) if n else documents([(0, "x")]).limit(0)
    rows = docs.select("doc_id", "source", merkle_manifest.leaf_digest("doc_id", "source", "lang", "n_chars", "text").alias("d"))
    got = merkle_manifest.manifest(rows.withColumn("given", F.col("d")), "doc_id", "source", "d", "given").collect()
    want = brute([r.asDict() for r in docs.collect()])
    assert ordered(r[:5] for r in got) == ordered(r[:5] for r in want)
    if n == 1:
        assert got[0]["leaf"] == got[0]["subroot"] == got[0]["root"] and got[0]["proof_sha256"] == h("")


def test_places_follow_the_order(spark):
    """Equal rows, more than a range holds, get numbers of their own."""
    prepare(spark)
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 40).alias("k"))
    rows = merkle_manifest.numbered(df, ["k"]).orderBy("place").collect()
    assert [r["place"] for r in rows] == list(range(3000))
    assert [r["k"] for r in rows] == sorted(r["k"] for r in rows)
