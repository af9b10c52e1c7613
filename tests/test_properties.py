"""Properties: traversal bounds, merge identities, streaming equals batch."""

from pyspark.sql import functions as F

from conftest import pages_of
from sitelens.operators import merge as M
from sitelens.operators import traverse as TR


def _graph(spark):
    # chain a→b→c→d→e plus a back edge and a shortcut
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "a"), ("a", "c")]
    return spark.createDataFrame(edges, "src string, dst string")


def test_bfs_depth_bounds_and_uniqueness(spark):
    t = TR.traverse(_graph(spark), spark.createDataFrame([("a",)], "url string"), max_depth=2)
    v = {r.url: r.depth for r in t.visited.collect()}
    assert v == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert t.visited.count() == t.visited.select("url").distinct().count()
    assert t.sizes == [1, 2, 1] and t.peak_frontier == 2


def test_bfs_depth_zero_visits_only_seeds(spark):
    t = TR.traverse(_graph(spark), spark.createDataFrame([("a",)], "url string"), max_depth=0)
    assert [r.url for r in t.visited.collect()] == ["a"]


def test_bfs_blocked_pages_are_leaves(spark):
    allowed = spark.createDataFrame([("a",), ("b",), ("d",)], "url string")  # c is blocked
    t = TR.traverse(_graph(spark), spark.createDataFrame([("a",)], "url string"), max_depth=3, expandable=allowed)
    assert {r.url: r.depth for r in t.visited.collect()} == {"a": 0, "b": 1, "c": 1}


def test_merge_with_empty_is_identity(spark):
    kw = spark.createDataFrame([("s", "alpha", 3), ("s", "beta", 1)], "site string, keyword string, frequency long")
    empty = kw.limit(0)
    got = {(r.keyword, r.frequency) for r in M.add_keywords(kw, empty).collect()}
    assert got == {("alpha", 3), ("beta", 1)}
    assert M.overwrite_by_key(kw, empty, ["site", "keyword"]).count() == 2


def test_merge_run_with_itself(spark):
    stats = spark.createDataFrame([("s", "average_response_time", 1.5), ("s", "min_response_time", 1.0)], "site string, stat string, value double")
    compat = {r.stat: r.value for r in M.merge_statistics(stats, stats).collect()}
    assert compat == {"average_response_time": 3.0, "min_response_time": 2.0}
    fixed = {r.stat: r.value for r in M.merge_statistics(stats, stats, mode="recompute").collect()}
    assert fixed["min_response_time"] == 1.0
    forms = spark.createDataFrame([("s", "/a")], "site string, action string")
    assert M.append_runs(forms, forms).count() == 2


def test_snapshot_diff(spark):
    old = spark.createDataFrame([("u1", "a"), ("u2", "b"), ("u3", "c")], "url string, html string")
    new = spark.createDataFrame([("u1", "a"), ("u2", "B"), ("u4", "d")], "url string, html string")
    got = {r.url: r.status for r in M.snapshot_diff(old, new).collect()}
    assert got == {"u1": "unchanged", "u2": "changed", "u3": "removed", "u4": "added"}


def test_subdomain_insert_if_absent(spark):
    from sitelens.operators import subdomains as SD

    old = spark.createDataFrame([("www.a.com", "1.1.1.1")], "subdomain string, ip string")
    new = spark.createDataFrame([("www.a.com", "9.9.9.9"), ("m.a.com", "2.2.2.2")], "subdomain string, ip string")
    got = {r.subdomain: r.ip for r in SD.insert_if_absent(old, new).collect()}
    assert got == {"www.a.com": "1.1.1.1", "m.a.com": "2.2.2.2"}


def test_statistics_approx_close_to_exact(spark):
    from sitelens.operators import stats as ST
    from sitelens.sources.pages import load_pages

    p = load_pages(spark, "/root/testdata/sf0.001")
    exact = {r.site: r.total_keywords for r in ST.site_statistics(p).collect()}
    approx = {r.site: r.total_keywords for r in ST.site_statistics(p, approx=True).collect()}
    assert exact.keys() == approx.keys()
    for k in exact:
        assert abs(exact[k] - approx[k]) <= max(3, 0.05 * exact[k])


def test_bfs_deep_chain(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(20)], "src string, dst string")
    t = TR.traverse(edges, spark.createDataFrame([("n0",)], "url string"), max_depth=15)
    got = {r.url: r.depth for r in t.visited.collect()}
    assert got == {f"n{i}": i for i in range(16)}
    assert t.sizes == [1] * 16 and t.peak_frontier == 1
