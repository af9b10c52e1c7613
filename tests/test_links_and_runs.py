"""Redirect chains, merges of several runs, searches of several domains and the plan of a level."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sitelens.functions.urls import in_scope
from sitelens.operators import linkgraph as LG
from sitelens.operators import merge as M
from sitelens.operators import redirects as RD
from sitelens.operators import stats as ST
from sitelens.operators import traverse as TR


def test_long_chains_loops_and_hubs(spark):
    """Chains of up to 300 hops, a loop with a tail, and many URLs that lead to one hub."""
    pairs = [(f"c{i}", f"c{i + 1}") for i in range(300)] + [("l0", "l1"), ("l1", "l2"), ("l2", "l0"), ("t0", "t1"), ("t1", "l1")]
    pairs += [(f"x{i}", "c290") for i in range(200)]
    hops = spark.createDataFrame(pairs, "src string, dst string").repartition(4)
    got = {r["url"]: (r["final"], r["hops"], r["loop"]) for r in RD.final_targets(hops).collect()}
    next_ = dict(pairs)
    for url in next_:
        at, n = url, 0
        while at in next_ and n < 1000:
            at, n = next_[at], n + 1
        assert got[url] == ((None, None, True) if n == 1000 else (at, n, False)), url
    assert RD.final_targets(hops.limit(0)).collect() == []


def test_hops_of_a_fetch_log(spark):
    rows = [(1, "2024-01-01", "b", ["a", "a2"]), (2, "2024-01-02", "z", ["a"]), (3, "2024-01-01", "q", []), (4, "2024-01-01", "s", ["s"])]
    log = spark.createDataFrame(rows, "event_id long, ts string, url string, redirects array<string>")
    assert {tuple(r) for r in RD.next_hops(log).collect()} == {("a", "z"), ("a2", "b")}


def test_broken_links_follow_redirects(spark):
    links = spark.createDataFrame([("p", t) for t in ("ok", "moved", "gone", "loop1", "to-missing")], "source string, target string")
    hops = spark.createDataFrame([("moved", "m2"), ("m2", "ok"), ("gone", "g404"), ("loop1", "loop2"), ("loop2", "loop1"), ("to-missing", "nowhere")], "src string, dst string")
    latest = spark.createDataFrame([("ok", 200, None), ("g404", 404, None), ("moved", 302, None)], "url string, status_code int, error_type string")
    got = {r["target"]: (r["final"], r["hops"], r["reason"]) for r in LG.broken_links(links, latest, RD.final_targets(hops)).collect()}
    assert got == {"gone": ("g404", 1, "status"), "loop1": (None, None, "loop"), "to-missing": ("nowhere", 1, "missing")}


@pytest.mark.parametrize("size", [5, 20, 1000])
def test_summary_bounds_hold(spark, size):
    """Each true count lies between frequency and frequency + error, and a certain keyword is in the true top."""
    rng = random.Random(size)
    runs = [Counter(f"w{int(rng.paretovariate(0.7)) % 120}" for _ in range(2000)) for _ in range(3)]
    frames = [spark.createDataFrame([("s", w, n) for w, n in c.items()], "site string, keyword string, frequency long") for c in runs]
    a, b, c = (M.keyword_summary(f, size) for f in frames)
    merged = M.merge_summaries(M.merge_summaries(a, b, size=size), c, size=size)
    true = sum(runs, Counter())
    top = M.top_of_summary(merged, 5).collect()
    kth = sorted(true.values(), reverse=True)[4]
    assert len(top) == 5
    for r in top:
        assert r["frequency"] <= true[r["keyword"]] <= r["frequency"] + r["error"]
        assert not r["certain"] or true[r["keyword"]] >= kth
    if size == 1000:
        assert [r["frequency"] for r in sorted(top, key=lambda r: r["rank"])] == sorted(true.values(), reverse=True)[:5]
        assert all(r["certain"] and not r["error"] for r in top)


def test_a_keyword_below_the_top_of_each_run_is_found(spark):
    """Third in each run, first in all: the compat merge of top lists of 2 loses it, summaries of 3 do not."""
    runs = [[("a1", 10), ("a2", 9), ("x", 8)], [("b1", 10), ("b2", 9), ("x", 8)], [("c1", 10), ("c2", 9), ("x", 8)]]
    frames = [spark.createDataFrame([("s", *r) for r in run], "site string, keyword string, frequency long") for run in runs]
    merged = M.merge_summaries(*[M.keyword_summary(f, 3) for f in frames], size=3)
    first = M.top_of_summary(merged, 1).first()
    assert (first["keyword"], first["frequency"], first["error"], first["certain"]) == ("x", 24, 0, True)


def test_distinct_counts_of_merged_runs(spark):
    """Ten addresses in both runs are ten: exact from facts, within the bound from sketches, unknown from numbers alone."""
    rows = lambda run, mails: [(f"https://e/{run}{i}", "emails", f"m{m}@e", 1) for i, m in enumerate(mails)] + [(f"https://e/{run}{i}", "pages", None, 1) for i in range(len(mails))]
    schema = "url string, kind string, value string, n long"
    facts = [spark.createDataFrame(rows(r, m), schema).withColumn("site", F.lit("e")) for r, m in (("a", range(10)), ("b", range(10)))]
    long = [ST.count_facts(f) for f in facts]
    value = lambda df: {r["stat"]: r["value"] for r in df.collect()}
    exact = ST.count_facts(M.merge_facts(*facts))
    assert value(exact) == {"unique_emails": 10, "total_urls_visited": 20}
    sketched = ST.count_sketches(ST.merge_sketches(*map(ST.sketch_facts, facts)))
    assert value(sketched) == {"unique_emails": 10, "total_urls_visited": 20}
    numbers = [df.withColumn("value", F.col("value").cast("double")) for df in long]
    assert value(M.merge_statistics(*numbers, mode="recompute"))["unique_emails"] is None
    assert value(M.merge_statistics(*numbers, mode="recompute", distinct=exact)) == {"unique_emails": 10.0, "total_urls_visited": 20.0}
    assert value(M.merge_statistics(*numbers))["unique_emails"] == 20.0


def test_domains_have_their_own_visits(spark):
    """Both domains reach the shared page, each at its own depth; each follows only links in its scope."""
    e = [("https://a.x/1", "https://a.x/2"), ("https://a.x/2", "https://s.a.x/b.y"), ("https://a.x/2", "https://b.y/1"), ("https://b.y/1", "https://s.a.x/b.y"), ("https://b.y/1", "https://s.a.x.b.y/"), ("https://a.x/1", "https://s.a.x.b.y/")]
    edges = spark.createDataFrame(e, "src string, dst string")
    seeds = spark.createDataFrame([("a.x", "https://a.x/1"), ("b.y", "https://b.y/1")], "domain string, url string")
    t = TR.traverse(edges, seeds, 3, in_scope=in_scope)
    got = {(r["domain"], r["url"]): r["depth"] for r in t.visited.collect()}
    assert got == {
        ("a.x", "https://a.x/1"): 0, ("a.x", "https://a.x/2"): 1, ("a.x", "https://s.a.x.b.y/"): 1, ("a.x", "https://s.a.x/b.y"): 2,
        ("b.y", "https://b.y/1"): 0, ("b.y", "https://s.a.x.b.y/"): 1,
    }


def test_a_level_leaves_the_edges_where_they_are(spark):
    """Only the frontier is shuffled to join the edges."""
    edges = TR.prepare_edges(spark.range(5000).select(F.concat(F.lit("u"), F.col("id") % 700).alias("src"), F.concat(F.lit("u"), F.col("id")).alias("dst")))
    frontier = spark.range(600).select(F.concat(F.lit("u"), F.col("id")).alias("url"))
    saved = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = frontier.join(edges, frontier["url"] == edges["src"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == sum(1 for i in range(5000) if i % 700 < 600)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", saved)
    side = plan[plan.index("src#") :] if "src#" in plan else plan
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan, side
