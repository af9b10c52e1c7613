"""Pattern tables: literals, and overrides of fingerprints, platforms and extensions."""

import re

import pytest
from conftest import pages_of
from pyspark.sql import functions as F

from sitelens.functions.lookups import SOCIAL_PLATFORMS, TECH_FINGERPRINTS
from sitelens.functions.patterns import literals_of
from sitelens.operators import extract as X


@pytest.mark.parametrize(
    "pattern,want",
    [
        (r"wp-content|wordpress", ["wp-content", "wordpress"]), (r"vue\.js", ["vue.js"]), (r"X-Powered-By.*Express", ["x-powered-by"]),
        (r"colou?r-scheme", ["r-scheme"]), (r"a(b|c)def", None), (r"\d+", None), (r"ab", None), (r"x{3}abcd", ["abcd"]), (r"[ab]cdef", None), (r"ng-", ["ng-"]),
    ],
)
def test_literals(pattern, want):
    assert literals_of(pattern) == want


def test_hits_equal_the_expressions_alone(spark):
    """Every fingerprint and platform, in any case, on texts that hold a literal without a match and the other way round."""
    texts = ["", None, "Server", "x-powered-by: PHP", "X-POWERED-BY then Express", "express X-Powered-By", "WP-Content", "NETFLIX.com", "x.com", "vueXjs vue.JS"]
    texts += ["Server: nginx\nServer: Apache", "ng-app REACT", "amazonaws.com", "a cf-ray b", "İSTANBUL drupal", "K jQuery"]
    df = pages_of(spark, [(i, "https://example.com/", t) for i, t in enumerate(texts)])
    got = {(r["page_id"], r["technology"]) for r in X.technologies(df).collect()}
    assert got == {(i, n) for i, t in enumerate(texts) for n, p in TECH_FINGERPRINTS if t and re.search(p, t, re.I | re.A)}
    links = pages_of(spark, [(i, "https://example.com/", f'<a href="https://{t}/p">x</a>') for i, t in enumerate(["X.com", "netflix.com", "GitHub.com", "reddit.org", "m.facebook.com"])])
    got = {(r["page_id"], r["platform"]) for r in X.social_links(links).collect()}
    assert got == {(0, "twitter"), (1, "twitter"), (2, "github"), (4, "facebook")} and len(SOCIAL_PLATFORMS) == 9


def test_overrides(spark):
    html = '<a href="/a.epub">e</a><a href="/b.pdf">p</a><a href="https://mastodon.social/@x">m</a><script src="htmx.min.js"></script>'
    df = pages_of(spark, [(1, "https://example.com/", html)]).withColumn("headers", F.create_map(F.lit("Via"), F.lit("Varnish 6")))
    techs = X.technologies(df, [("htmx", r"htmx(\.min)?\.js"), ("Varnish", "via: varnish"), ("none", "zzz")])
    assert {r["technology"] for r in techs.collect()} == {"htmx", "Varnish"}
    assert [r["platform"] for r in X.social_links(df, [("mastodon", r"mastodon\.social")]).collect()] == ["mastodon"]
    assert [r["file_type"] for r in X.files(df, [".epub"]).collect()] == ["epub"]
    assert X.files(df, []).count() == 0
