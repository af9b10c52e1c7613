"""Steps that must grow no faster than the pages: how rows are dealt, and how often a page is read."""

import re

import pytest
from conftest import pages_of
from pyspark.sql import functions as F

from sitelens.operators import extract as X
from sitelens.operators import stats as ST
from sitelens.operators.elements import attr, start_tags, tag_attrs
from sitelens.plans import compose, containment_plans, detail_plans
from sitelens.sources import pages as P

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("build", [
    compose.part_pages, compose.customer_pages, compose.tree_pages, detail_plans.detail_pages, containment_plans.soup_pages,
])
def test_composed_pages_are_dealt_by_rows(spark, monkeypatch, build):
    whole = build(spark, SF).select("page_id", "url", "html")
    monkeypatch.setattr(P, "ROWS_A_TASK", 25)
    dealt = build(spark, SF).select("page_id", "url", "html")
    n = whole.count()
    assert dealt.rdd.getNumPartitions() == -(-n // 25) > 1
    assert dealt.count() == n and dealt.exceptAll(whole).isEmpty()


def _plan(df, capsys) -> str:
    df.explain(mode="extended")
    return capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]


def test_tags_are_read_once_however_many_facts_ask(spark, capsys):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    pages = P.conform_pages(pages, site="example.com")
    for found in (X.endpoint_candidates(pages), X.endpoints(pages), ST.page_fact_rows(pages)):
        assert len(re.findall(re.escape("(?i)<(a|link|script|img|form"), _plan(found, capsys))) == 1


def test_only_the_attributes_asked_for(spark):
    tag = """<IMG DATA-SRC="d" data-alt='&amp;' SRC = 'a>&lt;' src="last" hidden alt title= x&amp;y width="" srcset=q ="z" alt=" 2">"""
    df = pages_of(spark, [(1, "https://example.com/", tag)])
    names = ("src", "alt", "title", "width", "height")
    values = lambda e: F.struct(*[attr(e, n).alias(n) for n in names])
    every, some = (F.transform(start_tags(F.col("html"), "img", attrs=a), values) for a in ((), names))
    row = df.select(every.alias("every"), some.alias("some")).first()
    assert row["every"] == row["some"]
    assert row["some"][0].asDict() == {"src": "last", "alt": " 2", "title": "x&y", "width": "", "height": None}
    kept = df.select(tag_attrs(F.lit(' data-src="1" src=2 SRC'), ("src",)).alias("a")).first()["a"]
    assert [(a["k"], a["v"]) for a in kept] == [("src", "2"), ("src", "")]


def test_attributes_of_any_text(spark):
    """The match that runs over attributes nobody asks for ends and begins them where reading all of them does."""
    import random

    rng = random.Random(6)
    pieces = ["alt", "ALT", "href", "data-alt", "altx", "x", "=", "=", '"', '"', "'", "'", " ", "\n", "\x0b", ">", "/", "&amp;", "\u00a0", " alt=", ' href="']
    texts = ["".join(rng.choices(pieces, k=rng.randrange(24))) for _ in range(4_000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    asked = lambda a: a["k"].isin("alt", "href")
    rows = df.select("t", F.filter(tag_attrs(F.col("t")), asked).alias("every"), tag_attrs(F.col("t"), ("alt", "href")).alias("some")).collect()
    assert [r["t"] for r in rows if r["every"] != r["some"]] == []
    assert sum(len(r["some"]) for r in rows) > 4_000


def test_a_reference_is_parsed_once(spark, capsys):
    """However often the character's bytes are asked for; and attributes nobody asks for make no strings."""
    from sitelens.functions.text import decode_entities
    from sitelens.operators.elements import ATTR_RE

    pages = P.conform_pages(spark.read.parquet(f"{SF}/pages.parquet"), site="example.com")
    plan = _plan(pages.select(decode_entities(F.col("html")).alias("t")), capsys)
    assert plan.count("^#(?:0*([0-9]+)") == 2 and plan.count("^#(?:[0-9]+|") == 1
    plan = _plan(pages.select(start_tags(F.col("html"), "img", attrs=("alt",)).alias("t")), capsys)
    assert f", {ATTR_RE}, 0" not in plan and plan.count("(?i:alt)") == 1


def test_references_of_every_kind(spark):
    import html as H

    from sitelens.functions.text import decode_entities

    texts = ["", "no", "&", "&&amp;&", "&rarr;&rarr", "&notit; &notin;", "&copy2 &copy;2", "&NotEqualTilde;x", "&#38;lt;&#x41 &bogus; &eacute"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(decode_entities(F.col("t"))).collect()]
    assert got == [H.unescape(t) for t in texts]


def test_a_search_asks_the_frontier_whether_it_expands(spark, monkeypatch):
    from sitelens.operators import traverse as TR

    rows = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "e"), ("d", "f")]
    edges = TR.prepare_edges(spark.createDataFrame(rows, "src string, dst string"))
    monkeypatch.setattr(TR, "prepare_edges", lambda e: pytest.fail("all edges are written again"))
    allowed = spark.createDataFrame([("a",), ("c",), ("c",), ("d",)], "url string")
    t = TR.traverse(edges, spark.createDataFrame([("a",)], "url string"), 3, expandable=allowed, prepared=True)
    assert sorted(map(tuple, t.visited.collect())) == [("a", 0), ("b", 1), ("c", 1), ("e", 2)]


def test_redirects_are_not_sent_through_the_driver(spark, capsys):
    from sitelens.operators import redirects as RD

    hops = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "src string, dst string")
    found = RD.targets_with_status(RD.final_targets(hops), spark.createDataFrame([("c", 200, None)], "url string, status_code int, error_type string"))
    assert sorted((r["url"], r["final"], r["hops"], r["loop"], r["final_status"]) for r in found.collect()) == [
        ("a", "c", 2, False, 200), ("b", "c", 1, False, 200), ("x", None, None, True, None), ("y", None, None, True, None)]
    found.explain()
    assert "Broadcast" not in capsys.readouterr().out


def test_an_arrival_slice_has_as_many_files_as_its_rows_need(spark, monkeypatch):
    import os

    from sitelens.plans import stream_plans as SP
    from sitelens.streaming import incremental as ST

    monkeypatch.setattr(SP, "ROWS_A_TASK", 3)
    path, schema, files = SP._page_arrivals(spark, SF)
    n = spark.read.parquet(f"{SF}/pages.parquet").count()
    assert files == -(-n // 12) > 1
    assert len([f for f in os.listdir(path) if f.endswith(".parquet")]) == 4 * files
    seen = []
    pages = ST.file_stream(spark, path, schema, files)
    writer = pages.writeStream.foreachBatch(lambda batch, i: seen.append((batch.count(), batch.rdd.getNumPartitions())))
    ST.run_available(spark, writer, path + "-ck")
    assert len(seen) == 4 and sum(c for c, _ in seen) == n


def test_report_lines_read_no_page_twice(spark, capsys):
    from sitelens.sinks import writers as W

    p = compose.part_pages(spark, SF)
    long = p.groupBy("site").agg(F.count("*").alias("value")).select("site", F.lit(0).cast("long").alias("ord"), F.lit("pages").alias("stat"), "value")
    none = spark.createDataFrame([], "site string, keyword string, frequency long, rank int")
    lines = W.report_lines(long, none, {"API Endpoints": X.api_endpoints(p).select("site", F.col("api").alias("value"))}, X.files(p))
    assert "regexp_extract_all" not in _plan(lines, capsys)


def test_a_run_of_tables_reads_its_pages_once(spark, capsys, monkeypatch):
    from sitelens.sinks import warehouse as WH
    from sitelens.sinks.writers import scratch_path

    asked, write = {}, WH.write_rows
    monkeypatch.setattr(WH, "write_rows", lambda df, path, *a: asked.update({path.rsplit("/", 1)[1]: _plan(df, capsys)}) or write(df, path, *a))
    p = compose.part_pages(spark, SF)
    WH.write_warehouse(p, scratch_path(spark, "t-once"))
    # words are counted over rows, all else was found in one pass before
    assert [name for name, plan in asked.items() if "regexp_extract_all" in plan] == ["keywords"]
    facts = WH.page_facts(p)
    for name in ("urls", "links", "technologies", "files", "forms", "images"):
        one, each = WH.warehouse_table(name, p, facts), WH.warehouse_table(name, p)
        assert one.count() == each.count() > 0 and one.exceptAll(each).isEmpty()
    monkeypatch.setattr(WH, "written", lambda df, name: df)
    assert _plan(WH.page_facts(p), capsys).count("(?is)(?=<[!s])") == 1


def test_literals_of_patterns_stand_for_themselves(spark):
    from sitelens.functions.patterns import holds_any

    df = spark.createDataFrame([("a.b*c-d_e ünd\n(x)[y]",), ("axbbc",), ("",), (None,)], "t string")
    for literals in (["a.b"], ["b*c-d_e"], ["nothing", "(x)[y]"], ["a.b*c-d_e", "axb+"]):
        assert [r[0] for r in df.select(holds_any(F.col("t"), literals)).collect()] == [True, False, False, None]


def test_plain_references_are_not_parsed(spark):
    """What needs no parsing comes to the same as what is parsed, and nothing else is taken for it."""
    from urllib.parse import urljoin

    from sitelens.functions.urls import _resolved_as_written, resolve

    bases = ["https://h.example/p/1/index.html?q#f", "https://h.example", "https://h.example/", "https://h.example/a//b", "https://h.example/a/../b/c"]
    plain = ["img/1.png", "../docs/2.pdf", "/css/site.css", "https://o.example/x/", "..a/b", "a/"]
    other = ["", "./a", "a/../b", "../../a", "..", "a//b", "/a/./b", "//h/x", "a?b", "#f", "mailto:x", " a", "a\n", "https://o.example/?"]
    rows = [(b, h) for b in bases for h in plain + other]
    df = spark.createDataFrame(rows, "base string, href string")
    got = df.select("base", "href", resolve(F.col("base"), F.col("href")).alias("r"), _resolved_as_written(F.col("base"), F.col("href")).alias("w")).collect()
    for r in got:
        assert r["r"] == urljoin(r["base"], r["href"]), r
        assert r["w"] is None or (r["w"] == r["r"] and r["href"] in plain), r
    assert all(r["w"] is not None for r in got if r["base"] == bases[0] and r["href"] in plain)
