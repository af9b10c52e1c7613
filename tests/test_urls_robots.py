"""URL joins against urllib.parse.urljoin and robots decisions against urllib.robotparser."""

import urllib.robotparser
from urllib.parse import urljoin

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitelens.functions.urls import resolve
from sitelens.operators import robots as RB

BASES = ["https://a.com", "https://a.com/", "https://a.com/b/c", "https://a.com/b/c/", "http://a.com/b/c?q=1#f",
         "https://a.com//x/y", "https://a.com/b/c.html"]
SEG = st.sampled_from(["", ".", "..", "x", "y.html", "z"])
HREF = st.builds(lambda segs, lead, tail: lead + "/".join(segs) + tail,
                 st.lists(SEG, min_size=1, max_size=4), st.sampled_from(["", "/", "./", "../", "//", "///"]),
                 st.sampled_from(["", "?k=v", "#frag", "?a#b", "?", "#", "?#", "\n", " "]))


@settings(max_examples=8, deadline=None)
@given(st.lists(HREF, min_size=20, max_size=60))
def test_resolve_matches_urljoin(spark, hrefs):
    pairs = [(b, h) for b in BASES for h in hrefs]
    got = spark.createDataFrame(pairs, "b string, h string").select("b", "h", resolve(F.col("b"), F.col("h")).alias("r")).collect()
    for r in got:
        assert r.r == urljoin(r.b, r.h), (r.b, r.h)


ROBOTS = [
    "User-agent: *\nDisallow: /private/\n",
    "User-agent: sitelensdesktop\nAllow: /a/b\nDisallow: /a/\n\nUser-agent: *\nDisallow: /\n",
    "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /x\n# comment\nDisallow: /y\n",
    "Disallow: /ignored\nUser-agent: *\n\nDisallow: /after-blank\nUser-agent: *\nDisallow: /z\n",
    "User-agent: SitelensDesktop\nUser-agent: bot2\nDisallow:\n\nUser-agent: *\nDisallow: /\n",
    "User-agent: *\nDisallow: /a\nUser-agent: sitelensmobile\nDisallow: /b\n",
]
ROBOTS += [
    "User-agent: *\nDisallow: /a%3cd\nDisallow: /café\nDisallow: /a b\nAllow: /q?\nDisallow: /q\nDisallow: *\nDisallow: /100%\n",
    "User-agent: *\nCrawl-delay: 5\nUser-agent: sitelensmobile\nDisallow: /y\nRequest-rate: 1/5\n\nUser-agent: x\nCrawl-delay: 3\n\nUser-agent: *\nDisallow: /z\n",
]
PATHS = ["/a%3Cd", "/a<d", "/a%3cd/x", "/caf%C3%A9", "/café/x", "/a%20b", "/a+b", "/q?k=1", "/q", "/100%25", "/100%", "/x?", "/y#", "/~u/*", "", "/", "/private/x", "/a/b/c", "/a/c", "/x1", "/y", "/after-blank", "/z", "/b", "/a"]


def test_robots_matches_stdlib(spark):
    agents = ["SitelensDesktop/1.0", "SitelensMobile/1.0"]
    robots = spark.createDataFrame([(f"s{i}.com", b) for i, b in enumerate(ROBOTS)], "site string, body string")
    urls = spark.createDataFrame([(f"s{i}.com", f"https://s{i}.com{p}") for i in range(len(ROBOTS)) for p in PATHS], "site string, url string")
    for agent in agents:
        got = {(r.site, r.url): r.allowed for r in RB.can_fetch(urls, robots, agent).collect()}
        for i, body in enumerate(ROBOTS):
            rp = urllib.robotparser.RobotFileParser()
            rp.parse(body.splitlines())
            for p in PATHS:
                u = f"https://s{i}.com{p}"
                assert got[(f"s{i}.com", u)] == rp.can_fetch(agent, u), (agent, body, p)


ODD = ["#", "?", "x#", "x?", "x?#", "?#f", " /x", "\n/x", " https://x.com/", "/a\nb", "https:g", "https:/g", "https:", "HTTPS://X.com/A", "HTTP://x.com",
       "http://x.com/..", "mailto:a@b.c", "javascript:void(0)", " ", "\x01y", "a\tb", "//h", "//h?q", "//h#f", "//h/../x", "///", "//", "https://", "https:///p",
       "http://[::1]/x", "https://[::1]:80/x", "x;p", "x;p?q", "a:b", "1:2", "./a:b", "x y", "é?ü#ö", "//u@h:1/x", "https:?q", "https:#f", "tel:1"]
BROKEN = ["http://[bad", "https://bad]", "//[bad/x", "https://[bad]/", "http://a[b]c/"]


def test_many_robots_rules(spark):
    import time

    def seconds(n):
        body = "User-agent: a\nDisallow: /\n\nUser-agent: *\n" + "".join(f"Disallow: /r{i}/\n" for i in range(n))
        robots = spark.createDataFrame([("s.com", body)], "site string, body string")
        urls = spark.createDataFrame([("s.com", f"https://s.com/r{n - 1}/x"), ("s.com", "https://s.com/x")], "site string, url string")
        t = time.time()
        both = RB.can_fetch_as(urls, robots, {"pc": "SitelensDesktop/1.0", "a": "a"}).orderBy("url").collect()
        assert [(r.pc, r.a) for r in both] == [(False, False), (True, False)]
        return time.time() - t

    seconds(100)
    assert seconds(10_000) < 20


def test_resolve_odd_references(spark):
    pairs = [(b, h) for b in [*BASES, "https://a.com/b?q", "HTTPS://A.com/b"] for h in ODD + BROKEN]
    got = spark.createDataFrame(pairs, "b string, h string").select("b", "h", resolve(F.col("b"), F.col("h")).alias("r")).collect()
    bad = [(r.b, r.h, r.r, urljoin(r.b, r.h)) for r in got if r.h in ODD and r.r != urljoin(r.b, r.h)]
    assert not bad, bad[:5]
    assert all(r.r is None for r in got if r.h in BROKEN)


def test_site_key_keeps_registered_names(spark):
    from sitelens.functions.urls import site_of

    urls = {"https://news.co.uk/x": "news.co.uk", "http://shop.com.au": "shop.com.au", "http://www.news.co.uk": "news.co.uk",
            "http://blog.a.example.net": "a.example.net", "http://news.com": "news.com", "http://m.x.org:80/": "x.org"}
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", site_of(F.col("u")).alias("s")).collect()
    assert {r.u: r.s for r in rows} == urls


def test_resolve_exhaustive_small_grammar(spark):
    import itertools

    hrefs = set()
    for n in range(1, 4):
        for comb in itertools.product(["", ".", "..", "x"], repeat=n):
            for lead in ["", "/", "./", "../", "//", "///"]:
                for tail in ["", "?k=v", "#frag"]:
                    hrefs.add(lead + "/".join(comb) + tail)
    pairs = [(b, h) for b in BASES for h in sorted(hrefs)]
    got = spark.createDataFrame(pairs, "b string, h string").select("b", "h", resolve(F.col("b"), F.col("h")).alias("r")).collect()
    bad = [(r.b, r.h, r.r) for r in got if r.r != urljoin(r.b, r.h)]
    assert not bad, bad[:5]
