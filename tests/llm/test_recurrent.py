"""The recurrent language model, against plain Python and finite differences."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelens.llm import queries, recurrent_lm
from sitelens.llm.common import prepare
from sitelens.llm.recurrent_lm import LANES, STEPS, Lanes, Network, fit, log_probabilities

from .test_text_operators import prose

ROWS = [(i, prose(10 + i, i)) for i in range(120)]
ROWS += [(200, None), (201, ""), (202, " \n\t"), (203, "A a É é\x1cb c\x0bd"), (7, ROWS[7][1]), (None, "never seen"), (None, "x")]
ROWS += [(205, prose(6_000, 4)), (206, "rare1 rare2 rare2"), (207, "rare2 the end")]


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) + [None]


def held(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 7 == 2


def brute(rows):
    count = Counter(w for i, t in rows if not held(i) for w in split(t))
    n, v = sum(count.values()), len(count)
    out = []
    for i, t in rows:
        words = split(t)
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words)
        out.append((i, held(i), len(words), sum(count[w] > 0 for w in words), n, base))
    return out


def key(r):
    return (r[0] is not None, r[0] or 0, r[2], r[5])


def test_query_counts_and_base(spark, documents, sf):
    got = queries.QUERIES["op11_recurrent_lm"](spark, sf(documents=documents(ROWS)))
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = sorted(map(tuple, got.collect()), key=key)
    want = sorted(brute(ROWS), key=key)
    assert [r[:5] for r in rows] == [w[:5] for w in want]
    assert np.allclose([r[5] for r in rows], [w[5] for w in want], rtol=1e-9)
    assert all(r[6] < 0 for r in rows)
    # on held-out text the model does at least about as well as its counts
    mine, base = (sum(r[c] for r in rows if r[1]) for c in (6, 5))
    assert mine > 1.02 * base
    same = [r[6] for r in rows if r[0] == 7]
    assert math.isclose(*same, rel_tol=1e-5)


@pytest.mark.parametrize("gathered", [1, 40, 1 << 18])
def test_counts_that_do_not_travel_are_joined(spark, documents, gathered):
    got = recurrent_lm.report(documents(ROWS), F.lit(False), gathered=gathered, classes=2, members=8, hidden=4)
    rows = sorted(map(tuple, got.collect()), key=key)
    count = Counter(w for _, t in ROWS for w in split(t))
    n, v = sum(count.values()), len(count)
    want = {(i, len(split(t))): sum(math.log10((count[w] + 1) / (n + v + 1)) for w in split(t)) for i, t in ROWS}
    assert all(r[3] == r[2] and math.isclose(r[5], want[r[0], r[2]], rel_tol=1e-9) for r in rows)


def test_no_training_rows_and_no_rows(spark, documents):
    prepare(spark)
    rows = recurrent_lm.report(documents([(1, "a b"), (2, None)]), F.lit(True)).collect()
    assert [(r["n_known"], r["train_tokens"], r["base_score"]) for r in rows] == [(0, 0, 0.0)] * 2
    assert all(-1e-5 < r["score"] <= 0 for r in rows)
    assert recurrent_lm.report(documents([(1, "a")]).limit(0), F.lit(False)).collect() == []


def small(dtype=np.float64):
    net = Network(10, hidden=5, members=4, dtype=dtype)
    rng = np.random.default_rng(0)
    flat = net.initial(np.arange(10, 0, -1.0), 7)
    return net, (flat + rng.normal(0, 0.3, len(flat))).astype(dtype), rng


def test_gradient_equals_finite_differences():
    net, flat, rng = small()
    x, y, h = rng.integers(0, 12, (6, 3)), rng.integers(0, 11, (6, 3)), rng.normal(0, 0.5, (3, 5))
    y[4, 1] = -1
    g, *_ = net.gradient(net.parts(flat), x, y, h)
    for i in range(0, len(flat), 3):
        e = np.zeros_like(flat)
        e[i] = 1e-5
        up, down = (net.gradient(net.parts(f), x, y, h)[1] / 17 for f in (flat + e, flat - e))
        assert abs((up - down) / 2e-5 - g[i]) < 1e-7


def plain_log_probability(net, p, ids):
    """One document, one token at a time."""
    h, before, total = np.zeros(net.hidden), net.start, 0.0
    n = net.hidden
    for y in ids:
        g, a = p["embed"][before] @ p["wx"] + p["bx"], h @ p["u"] + p["bu"]
        z, r = (1 / (1 + np.exp(-(g[k : k + n] + a[k : k + n]))) for k in (0, n))
        c = np.tanh(g[2 * n :] + r * a[2 * n :])
        h = (1 - z) * c + z * h
        logits = h @ p["wc"] + p["bc"]
        cls = net.classes - 1 if y == net.open else y // net.members
        total += logits[cls] - np.log(np.exp(logits).sum())
        if y != net.open:
            logits = p["ww"][cls] @ h + p["bw"][cls]
            total += logits[y % net.members] - np.log(np.exp(logits).sum())
        before = y
    return total


@pytest.mark.parametrize("lanes,steps", [(1, 3), (4, 7), (50, 64)])
def test_state_is_carried_through_whole_documents(lanes, steps):
    net, flat, rng = small()
    docs = [rng.integers(0, 11, n) for n in (1, 2, 700, 7, 14, 1, 30, 3, 3, 65, 64, 63)]
    got = dict(log_probabilities(net, flat, enumerate(docs), lanes, steps))
    assert sorted(got) == list(range(len(docs)))
    for i, ids in enumerate(docs):
        assert math.isclose(got[i], plain_log_probability(net, net.parts(flat), ids), rel_tol=1e-9)


def test_probabilities_sum_to_one():
    net, flat, _ = small()
    for before in ([], [3], [10, 2]):
        first = plain_log_probability(net, net.parts(flat), before)
        p = [math.exp(plain_log_probability(net, net.parts(flat), [*before, y]) - first) for y in range(11)]
        assert math.isclose(sum(p), 1, rel_tol=1e-9)


def test_lanes_hold_every_token_once():
    docs = [np.arange(n) + 100 * i for i, n in enumerate((5, 1, 12, 3, 8))]
    side, seen = Lanes(((i, d) for i, d in enumerate(docs)), 2, -5), {i: [] for i in range(5)}
    while True:
        x, y, pieces = side.window(4)
        if not pieces:
            break
        for i, lane, a, b, _ in pieces:
            before = [-5, *docs[i]][len(seen[i]) : len(seen[i]) + b - a]
            assert x[a:b, lane].tolist() == before
            seen[i] += y[a:b, lane].tolist()
    assert all(seen[i] == d.tolist() for i, d in enumerate(docs))


def test_training_learns_an_order():
    """Texts that count in a circle become likely; texts of the same tokens in another order do not."""
    net = Network(8, hidden=8, members=4)
    rng = np.random.default_rng(1)
    docs = [(np.arange(40) + rng.integers(8)) % 8 for _ in range(3_000)]
    flat = net.initial(np.ones(8), 1)
    after, seen = fit(net, flat, iter(docs), every=1)
    assert seen == 3_000 * 40
    other = [rng.permutation(d) for d in docs[:50]]
    before, good, bad = (sum(dict(log_probabilities(net, f, enumerate(d))).values()) for f, d in ((flat, docs[:50]), (after, docs[:50]), (after, other)))
    assert good > 0.5 * before > bad


def test_every_window_of_every_text_is_trained():
    """By default no window is passed over, and lanes that run idle change nothing."""
    net, flat, rng = small(np.float32)
    docs = [rng.integers(0, 11, n) for n in (700, 1, 2, 65, 33, 64, 900, 5)]
    assert fit(net, flat, iter(docs))[1] == sum(map(len, docs))
    side = Lanes(enumerate(docs), 4, net.start)
    h = np.arange(4)[:, None]
    widths = []
    while side.window(32)[2]:
        h = side.narrowed(h)
        assert len(h) == len(side.now) and (side.more or None not in side.now)
        widths.append(len(h))
    assert widths[0] == 4 and widths[-1] == 0 and widths == sorted(widths, reverse=True)


def test_windows_reuse_their_memory():
    """A window's arrays are not given back to the system and fetched again, page by page, for the next one."""
    import subprocess
    import sys

    code = """
import resource, numpy as np
from sitelens.llm.recurrent_lm import LANES, STEPS, Network, fit
net = Network(4096)
flat = net.initial(np.arange(4096, 0, -1.0), 9.0)
faults = []
for n in (5, 45):
    rng = np.random.default_rng(0)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    fit(net, flat, (rng.integers(0, 4097, STEPS) for _ in range(n * LANES)))
    faults.append(resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before)
print((faults[1] - faults[0]) / 40)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=120)
    assert float(done.stdout) < 100


def test_words_of_a_column_are_the_tokens_of_each_text():
    """The Arrow kernels cut texts like ``tokens``: only A-Z is lowered, only six characters part words, any bytes pass."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    signs = [b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r", b"\x1c", b"\x1f", b"\x00", b"\x85", b"\xff", b"\xc2\xa0", "é".encode(), "É".encode(), "İ".encode(), b"A", b"Z", b"[", b"@", b"a"]
    raw = [b"".join(signs[i] for i in rng.integers(0, len(signs), rng.integers(0, 25))) for _ in range(2_000)] + [None, b"", b" ", None]
    plain = pa.array(raw, pa.binary())
    texts = pa.Array.from_buffers(pa.string(), len(plain), plain.buffers())
    words, lengths = recurrent_lm._words(texts)
    want = [recurrent_lm.tokens(t)[:-1] for t in raw]
    assert words.to_pylist() == [w for ws in want for w in ws] and lengths.tolist() == list(map(len, want))
    for held, piece in ((1, 1), (1 << 25, 1 << 22), (1000, 50)):
        count, before = Counter(), (recurrent_lm.HELD, recurrent_lm.PIECE)
        recurrent_lm.HELD, recurrent_lm.PIECE = held, piece
        try:
            for part in recurrent_lm._count(iter([pa.record_batch({"t": texts}), pa.record_batch({"t": texts.slice(0, 0)}), pa.record_batch({"t": texts[:7]})])):
                for token, n in zip(*(c.to_pylist() for c in part.columns)):
                    count[token] += n
        finally:
            recurrent_lm.HELD, recurrent_lm.PIECE = before
        assert count == Counter(w for t in raw + raw[:7] for w in recurrent_lm.tokens(t))


def test_a_window_computes_no_more_than_its_tokens_need():
    """Softmaxes run over real tokens only, without filling up classes, and the gates' input once for each different input."""
    net, rng = Network(4096), np.random.default_rng(0)
    p = net.parts(net.initial(np.arange(4096, 0, -1.0), 9.0))
    x, y = (np.minimum(rng.zipf(1.2, (STEPS, LANES)), 4096) for _ in range(2))
    cells, inputs = [], []
    shares, table = net._shares, net.table
    net._shares = lambda logits, *rest: cells.append(logits.size) or shares(logits, *rest)
    net.table = lambda q, embed: inputs.append(len(embed)) or table(q, embed)
    net.gradient(p, x, y, np.zeros((LANES, net.hidden), np.float32))
    assert sum(cells) == y.size * net.classes + int((y < net.open).sum()) * net.members
    assert inputs == [len(np.unique(x))]


def test_windows_of_a_long_window_hold_the_same():
    docs = [np.arange(n) + 1000 * i for i, n in enumerate((5, 1, 120, 3, 8, 40, 7))]
    whole, parts = (Lanes(((i, d) for i, d in enumerate(docs)), 3, -5) for _ in range(2))
    while True:
        x, y, pieces = whole.window(16)
        xs, ys, _ = parts.window(16)
        if not pieces:
            break
        got = np.full(y.shape, -1)
        for t, used, a, b in parts.cut(xs, ys, 4):
            got[t : t + 4, used] = b
            assert (a == x[t : t + 4, used]).all() and (b >= 0).any(0).all()
        assert (got == y).all()


def test_steps_are_those_of_adam():
    rng = np.random.default_rng(5)
    start = rng.normal(0, 1, 40_000)
    adam = recurrent_lm.Adam(start.copy(), 0.02)
    flat, mean, m, v = start.copy(), start.copy(), 0.0, 0.0
    for k in range(1, 8):
        g = rng.normal(0, 10.0 ** -(k % 4 + 2), len(flat))
        adam.step(g.copy())
        g /= max(np.linalg.norm(g), 1)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        flat = flat - 0.02 / math.sqrt(1 + k / 50) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-6)
        mean = mean + 3 / (k + 2) * (flat - mean)
    assert np.allclose(adam.flat, flat, rtol=0, atol=1e-10) and np.allclose(adam.mean, mean, rtol=0, atol=1e-10)


@pytest.mark.parametrize("modelled", [3, 40_000])
def test_ids_pass_through_spark_as_bytes(spark, documents, modelled):
    """Two bytes an id, or four where two are too few; a document's ids are those of its tokens."""
    prepare(spark)
    head = [(b"a", 5), (b"", 4), (b"b", 3), (b"c", 2)]
    texts = {1: "A b c d", 2: None, 3: " c\nc ", 4: "d d e"}
    made = recurrent_lm.encode(documents(list(texts.items())), "doc_id", "text", F.lit(False), head, modelled)
    assert made.schema["ids"].dataType.simpleString() == "binary"
    place = {t: i for i, (t, _) in enumerate(head)}
    for r in made.collect():
        words = recurrent_lm.tokens((texts[r["key"]] or "").encode())
        ids = [place.get(w, modelled) if place.get(w, modelled) < modelled else modelled for w in words]
        assert np.frombuffer(r["ids"], "<i2" if modelled == 3 else "<i4").tolist() == ids
        assert dict(zip(map(bytes, r["rare"]), r["times"])) == Counter(w for w in words if w not in place)
        assert (r["n_tokens"], r["n_known"], r["n_open"]) == (len(words), sum(w in place for w in words), sum(i == modelled for i in ids))
        assert math.isclose(r["logs"], sum(math.log10(dict(head)[w] + 1) for w in words if w in place), abs_tol=1e-12)


def test_long_texts_are_cut_few_at_once(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(recurrent_lm, "PIECE", 100)
    texts = [None, "", "a" * 60, "b" * 60, "c" * 1_000, None, *["d" * 9] * 50, ""]
    batch = pa.record_batch({"i": pa.array(range(len(texts))), "t": pa.array(texts)})
    pieces = list(recurrent_lm._pieces(iter([batch, batch.slice(0, 0), batch.slice(3, 2)]), 1))
    assert [t for b in pieces for t in b.column(1).to_pylist()] == texts + texts[3:5]
    for b in pieces:
        sizes = [len(t or "") for t in b.column(1).to_pylist()]
        assert sum(sizes) - max(sizes) <= 100
