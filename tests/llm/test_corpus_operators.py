"""Operators that compare rows of the corpus, against plain Python."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

import corpus_pipeline
from sitelens.llm import chat_rotation, decontaminate, queries, simhash, url_cascade
from sitelens.llm.common import prepare, store

from .test_text_operators import prose

# ---- simhash


def brute_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, ids, radius):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(prints)):
        groups.setdefault(find(i), []).append(i)
    out = [None] * len(prints)
    for members in groups.values():
        known = [ids[i] for i in members if ids[i] is not None]
        for i in members:
            out[i] = min(known, default=None)
    return out


def test_simhash_query(spark, documents, sf):
    base = prose(400, 5)
    near = [(50 + i, base.replace("erst", f"erst{i}", 1)) for i in range(25)]
    rows = [(i, prose(30 + i, i)) for i in range(40)] + near
    rows += [(900, None), (901, ""), (902, " \n"), (903, "One"), (904, "one"), (905, "a\u00a0b ÉT c"), (7, rows[7][1]), (None, base), (None, "z")]
    rows += [(906, prose(40_000, 77))]
    got = queries.QUERIES["op3_simhash"](spark, sf(documents=documents(rows))).collect()
    prints = [brute_print(t) for _, t in rows]
    comps = brute_components(prints, [i for i, _ in rows], 2)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted(((i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, comps)), key=key)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=key) == want


@pytest.mark.parametrize("tile_rows", [4096, 6])
def test_links_are_complete(spark, tile_rows):
    """Random fingerprints, chains of close ones and a bucket that is split into tiles."""
    prepare(spark)
    rng = np.random.default_rng(3)
    prints = set(rng.integers(0, 1 << 63, 300, dtype=np.uint64).tolist()) | {0, (1 << 64) - 1}
    for p in list(prints)[:30]:
        for _ in range(6):  # a chain
            p ^= (1 << int(rng.integers(64))) | (1 << int(rng.integers(64)))
            prints.add(p)
    prints |= {(5 << 50) | int(x) for x in rng.integers(0, 1 << 20, 120)}  # one hot block
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    fps = spark.createDataFrame([(p,) for p in signed], "fp long").repartition(4)
    roots = {r.node: r.root for r in simhash.components(simhash.close_links(fps, 2, tile_rows)).collect()}
    got = [roots.get(p, p) for p in signed]
    want = brute_components(prints, signed, 2)
    assert got == want


def test_tiles_skip_only_what_is_far():
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 1 << 16, 900, dtype=np.uint64))
    b = np.unique(rng.integers(0, 1 << 16, 500, dtype=np.uint64))
    for other in (None, b):
        p, q = simhash.compare(a, other, 2, tile=32)
        far = a if other is None else b
        want = {(int(x), int(y)) for x in a for y in far if (int(x) ^ int(y)).bit_count() <= 2 and (other is not None or x != y)}
        pairs = {(int(x), int(y)) for x, y in zip(p, q)}
        assert (pairs if other is not None else pairs | {(y, x) for x, y in pairs}) == want


def test_long_chains_join(spark):
    prepare(spark)
    links = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    links = links.union(spark.createDataFrame([(1000, 2000), (3000, 2000), (5, 5)], "a long, b long"))
    got = {r.node: r.root for r in simhash.components(links).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and got[2000] == got[3000] == 1000


# ---- decontamination


def split(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute_hits(text, items, window=10):
    words, hit, found = split(text), set(), set()
    for item, body in items:
        w = split(body)
        if not w:
            continue
        n = min(window, len(w))
        phrases = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in phrases:
                hit.update(range(i, i + n))
                found.add("" if item is None else str(item))
    return len(words), len(hit), sorted(found)


ITEMS = [
    (1, prose(40, 100)), (10, prose(12, 101)), (2, "Three short words"), (3, "single"), (4, None), (5, ""), (6, "... !!"),
    (7, prose(40, 100)), (None, "é à ü ö ß É À ñ ç œ æ"), (8, "the the the the the the the the the the the"), (1, prose(40, 100)),
]
HITS = [
    (1, prose(40, 100)), (2, "x " + " ".join(prose(40, 100).upper().split()[3:17]) + " y"), (3, " ".join(prose(40, 100).split()[:9])),
    (4, prose(12, 101).replace(" ", "\n--\t")), (5, "three SHORT-words, single"), (6, None), (7, ""), (8, "é à ü ö ß é À ñ ç œ æ É à"),
    (9, "é à ü ö ß É À ñ ç œ æ"), (10, "the " * 50), (11, prose(300, 200)), (2, "again " + prose(40, 100)), (None, prose(40, 100)),
    (12, "word " * 60_000 + prose(40, 100)), (11, prose(300, 200)),
]


def test_decontamination_query(spark, documents, sf):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = queries.QUERIES["op4_decontamination"](spark, sf(documents=documents(HITS), benchmark=items)).collect()
    want = []
    for doc_id, text in HITS:
        n, hit, found = brute_hits(text, ITEMS)
        want.append((doc_id or 0, n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0))
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == sorted(want)


def brute_near(texts, items, slop=3, missing=2, window=10):
    """Of each text the windows with a place near which all but ``missing`` terms stand, two of the three rarest among
    them, and which it does not hold exactly."""
    cut = lambda t: [w for w in re.split(r"[^0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in t or "")) if w]
    docs = [cut(t) for t in texts]
    count = Counter(w for d in docs for w in d)
    wins = {}
    for item, t in items:
        w = cut(t)
        for i in range(max(len(w) - window, 0) + 1 if w else 0):
            wins.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    out = []
    for d in docs:
        at = {}
        for i, w in enumerate(d):
            at.setdefault(w, []).append(i)
        found = set()
        for win in wins:
            n = len(win)
            order = sorted((count[w] == 0, count[w], off, w) for off, w in enumerate(win))
            rare = [(off, w) for none, _, off, w in order[:3] if not none]
            close = lambda off, w, s: any(abs(x - s - off) <= slop for x in at.get(w, []))  # noqa: E731, B023
            places = set()
            for k, (off, w) in enumerate(rare[:2]):
                for s in (x - off for x in at.get(w, [])):
                    if n == 1 or any(close(o, v, s) for o, v in rare[k + 1 :]):
                        places.add(s)
            held = any(tuple(d[s : s + n]) == win for s in places if s >= 0)
            near = any((t := sum(close(o, w, s) for o, w in enumerate(win))) >= n - missing and t >= min(n, 2) for s in places)
            if near and not held:
                found.add(win)
        out.append((len(found), sorted({i for w in found for i in wins[w]})))
    return out


def test_proximity_equals_brute_force(spark, documents):
    """Words inserted, dropped, replaced and moved: the matches of plain Python, and one changed word is always found."""
    rng = np.random.default_rng(8)
    pool = [f"w{i}" for i in range(400)]
    items = [(k, " ".join(rng.choice(pool, int(n)))) for k, n in enumerate([10, 14, 10, 30, 10, 4, 2, 1])]
    texts, single = [], []
    for k, (_, item) in enumerate(items[:5]):
        words = item.split()[:10]
        for i in range(10):
            around = rng.choice(pool, 30).tolist()
            for kind in ("replace", "drop", "insert", "move", "two"):
                w = list(words)
                if kind == "replace":
                    w[i] = "zz"
                elif kind == "drop":
                    del w[i]
                elif kind == "insert":
                    w.insert(i or 5, "yy")
                elif kind == "move":
                    w.insert((i + 2) % 9, w.pop(i))
                else:
                    w[i], w[(i + 3) % 10] = "p", "q"
                texts.append(" ".join(around[:15] + w + around[15:]))
                single.append((kind, k))
    texts += [t for _, t in items] + ["", None, "w1 w1 w1 " * 30, " ".join(rng.choice(pool, 3_000))]
    want = brute_near(texts, items)
    df = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(list(enumerate(texts)))
    got = {r.doc_id: (r.n_near, r.near_items) for r in decontaminate.report(docs, df).collect()}
    assert [got[i] for i in range(len(texts))] == want
    hit = {kind: [str(k) in want[i][1] for i, (x, k) in enumerate(single) if x == kind] for kind in ("replace", "drop", "insert", "move", "two")}
    assert all(np.mean(hit[k]) == 1 for k in ("replace", "drop", "insert", "move")) and np.mean(hit["two"]) > 0.8, {k: np.mean(v) for k, v in hit.items()}


def test_matches_have_place_and_kind(spark, documents):
    prepare(spark)
    item = "alpha bravo charlie delta echo foxtrot golf hotel india juliet"
    items = spark.createDataFrame([(1, item), (9, item)], "item_id long, text string")
    w = item.split()
    texts = {1: "x y " + item, 2: " ".join(w[:4] + ["um"] + w[4:]), 3: " ".join(reversed(w)), 4: " ".join(w[:5] + ["x"] * 9 + w[5:]), 5: "x"}
    rows = decontaminate.find(documents(list(texts.items())), items).collect()
    assert {(r.item, r.kind, r.start, r.n_words, r.terms) for r in rows if r.doc_id == 1} == {(i, "exact", 2, 10, 10) for i in ("1", "9")}
    near = {(r.item, r.kind, r.terms) for r in rows if r.doc_id == 2}
    assert near == {("1", "near", 10), ("9", "near", 10)} and all(abs(r.start) <= 1 for r in rows if r.doc_id == 2)
    assert {r.doc_id for r in rows} == {1, 2}
    got = {r.doc_id: (r.n_hit, r.n_near) for r in decontaminate.report(documents(list(texts.items())), items).collect()}
    assert got == {1: (10, 0), 2: (0, 1), 3: (0, 0), 4: (0, 0), 5: (0, 0)}


def test_decontamination_of_empty_tables(spark, documents, sf):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.report(documents([]), items).count() == 0
    [row] = decontaminate.report(documents([(1, "a b c")]), items.limit(0)).collect()
    assert (row.n_words, row.n_hit, row["items"], row.n_near) == (3, 0, [], 0)


# ---- urls


URLS = [
    "http://a.org/x", "https://www.Example.ORG/es/1", "http://example.org/en/12?x#y", "http://example.org/en/2", "http://com/fr/", "x://sub.a.com/de/z",
    "http://notexample.org/es/", "http://org", "http://org?/", "http://a.net/", "no scheme/fr/", "", None, "http://", "://org/", "http://a.com:80/de/",
    "http://b.com/de", "http://c.org/a://b", "http://x.org/x\ny", "http://" + "a." * 5000 + "org/" + "p" * 50_000, "http://a.org/x",
]


def brute_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_url_query(spark, sf):
    rows = [(i, u, "x") for i, u in enumerate(URLS)] + [(None, URLS[0], "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, key string").withColumn("host", F.lit("clash"))
    got = queries.QUERIES["op7_url_cascade"](spark, sf(pages=pages)).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got), key=key) == [
        *((i, *brute_url(u)) for i, u in enumerate(URLS)), (None, *brute_url(URLS[0]))
    ]


def test_cascade_is_exact(spark, monkeypatch):
    """With one bit a key the first levels err often; the cascade corrects them all."""
    prepare(spark)
    monkeypatch.setattr(url_cascade, "BITS", 1)
    universe = store(spark.range(4000).select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("key")), "u")
    listed = universe.filter("substring(key, 2) % 13 = 0")
    levels = url_cascade.build(listed.union(spark.createDataFrame([("unseen",), (None,), ("h0",)], "key string")), universe)
    assert len(levels) > 2
    wrong = universe.filter(url_cascade.member(levels, F.col("key")) != F.expr("substring(key, 2) % 13 = 0"))
    assert wrong.count() == 0
    assert url_cascade.build(listed.limit(0), universe) == []


# ---- dialogues


TALK = [
    (1, 0, "system", "Be kind."), (1, 1, "ann", "Hi"), (1, 2, "bob", None), (1, 3, "ann", "é"), (1, 3, "cleo", ""), (1, 3, "ann", "é"),
    (2, 0, "system", "alone"), (3, 0, None, "who?"), (3, 1, "dan", "me"), (None, 0, "eve", "lost"), (None, 1, "fay", "too"), (4, None, "gus", "when"),
]


def brute_rotation(rows):
    out = []
    for conv in {r[0] for r in rows}:
        said = [r for r in rows if r[0] == conv]
        for person in {s for _, _, s, _ in said if s not in (None, "system")}:
            for _, turn, s, text in said:
                role = "system" if s == "system" else "assistant" if s == person else "user"
                name = (s or "unknown") if role == "user" else None
                head = f"<|im_start|>{role}{' name=' + name if name else ''}\n"
                whole = head + (text or "") + "<|im_end|>\n"
                end = len(whole) - 1 if role == "assistant" else len(head)
                out.append((conv, person, turn, s, role, name, whole, len(head), end, role == "assistant"))
    return sorted(out, key=str)


def test_rotation(spark, sf):
    talk = spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string").withColumn("perspective", F.lit("clash"))
    got = queries.QUERIES["op1_perspective_rotation"](spark, sf(conversations=talk)).collect()
    assert sorted(map(tuple, got), key=str) == brute_rotation(TALK)
    empty = chat_rotation.rotate(talk.limit(0), "conv_id", "turn", "role", "text")
    assert empty.count() == 0


def test_whole_dialogues(spark):
    talk = spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string")
    rotated = chat_rotation.rotate(talk, "conv_id", "turn", "role", "text")
    whole = {(r.conv_id, r.perspective): r for r in chat_rotation.dialogues(rotated, "conv_id", "turn").collect()}
    ann = whole[1, "ann"]
    assert [ann.rendered[s.start : s.end] for s in ann.spans] == ["Hi<|im_end|>", "é<|im_end|>", "é<|im_end|>"]
    assert ann.rendered.startswith("<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>assistant\nHi")
    assert (1, "ann") not in {(r.conv_id, r.perspective) for r in chat_rotation.dialogues(rotated, "conv_id", "turn", 5).collect()}


def test_every_perspective_has_one_order(spark):
    """Messages of one turn, by two speakers and of equal text, stand in the same order for both; so they do in a long talk."""
    rows = [(1, 5, "zoe", "b"), (1, 5, "ann", "z"), (1, 5, "zoe", "a"), (1, 5, "ann", "b"), (1, 5, None, "q"), (1, 5, "system", "s")]
    rows += [(2, i // 3, "abc"[i * 7 % 3], f"m{i}") for i in range(1_900)]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    rotated = chat_rotation.rotate(talk, "conv_id", "turn", "role", "text")
    for conv, people in ((1, ["zoe", "ann"]), (2, ["a", "b", "c"])):
        said = [(t, s is not None, s or "", x) for c, t, s, x in rows if c == conv]
        want = [x for *_, x in sorted(said)]
        for r in chat_rotation.dialogues(rotated.filter(F.col("conv_id") == conv), "conv_id", "turn").collect():
            assert r.perspective in people
            assert re.findall(r"\n(.*)<\|im_end\|>", r.rendered) == want


# ---- pipeline


def test_pipeline_stages(spark, documents, sf):
    base = prose(400, 5)
    item = prose(40, 300)
    good = [(i, prose(60 + i % 40, i)) for i in range(120)]
    bad = [(1000 + i, " ".join(w + "%*#"[i % 3] * 3 for w in prose(80, i).split())) for i in range(60)]
    rows = good + bad + [(300, base), (301, base), (302, base.replace("erst", "erstx", 1)), (300, base), (None, base)]
    rows += [(400, prose(30, 301) + " " + item), (500, prose(90, 302) + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" ' + prose(30, 303))]
    labels = [(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad]
    docs = documents(rows)
    folder = sf(
        documents=docs,
        labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        benchmark=spark.createDataFrame([(1, item)], "item_id long, text string"),
    )
    ids = []
    for name, stage in corpus_pipeline.STAGES:
        docs = store(stage(spark, docs, folder), "test-stage")
        if name != "pack":
            assert docs.columns == corpus_pipeline.COLUMNS
        ids.append([r.doc_id for r in docs.collect()])
        if name == "near_dedup":
            texts = {r.doc_id: r.text for r in docs.collect()}
    quality, dedup, clean, masked, packed = ids
    assert {i for i, _ in good} <= set(quality) and sum(i is not None and i >= 1000 for i in quality) <= 3
    kept = [i for i, t in rows if i in set(quality)]
    prints = [brute_print(t) for i, t in rows if i in set(quality)]
    want = {c for c in brute_components(prints, kept, 2)}
    assert sorted(dedup) == sorted(want) and dedup.count(300) == 1 and None not in dedup
    assert sorted(clean) == sorted(i for i in dedup if not brute_hits(texts[i], [(1, item)])[1]) and 400 not in clean
    assert sorted(masked) == sorted(clean) and set(packed) == set(masked)
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == set(packed)


def test_pipeline_of_nothing(spark, documents, sf):
    folder = sf(
        documents=documents([]),
        labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"),
        benchmark=spark.createDataFrame([], "item_id long, text string"),
    )
    assert corpus_pipeline.run(spark, folder).count() == 0
