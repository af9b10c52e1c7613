"""Nested intervals of a page's tags, against the standard library's parser and a plain tree."""

import random
import time
from html.parser import HTMLParser

import pytest
from conftest import pages_of
from pyspark.sql import functions as F

from sitelens.operators import extract as X
from sitelens.operators.containment import VOID, intervals


class Tree(HTMLParser):
    """Open elements as a list; texts and fields are given to all, or the innermost, at once."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.found, self.fields = [], [], []

    def handle_starttag(self, tag, attrs):
        e = {"tag": tag, "attrs": dict(attrs), "text": "", "own": tag in VOID, "next": False}
        kind = "h" if tag in ("h1", "h2", "h3") else tag
        for o in self.found:  # an element that will turn out unclosed takes no text from here on
            if o["kind"] == kind:
                o["next"] = True
        e["kind"] = kind
        self.found.append(e)
        if tag in ("input", "select", "textarea"):
            forms = [o for o in self.open if o["tag"] == "form"]
            self.fields.append((dict(attrs).get("name"), forms[-1]["attrs"].get("action") if forms else None))
        if tag not in VOID:
            self.open.append(e)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()["own"] = True

    def handle_endtag(self, tag):
        if any(o["tag"] == tag for o in self.open):
            while True:
                o = self.open.pop()
                if o["tag"] == tag:
                    o["own"] = True
                    break

    def handle_data(self, data):
        for o in self.open:
            o["text"] += data
            if not o["next"]:
                o["alone"] = o.get("alone", "") + data


def read(html):
    t = Tree()
    t.feed(html)
    t.close()
    for e in t.found:
        if not e["own"]:
            e["text"] = e.get("alone", "")
    return t


def soup(seed):
    rng = random.Random(seed)
    out = []
    for i in range(rng.randrange(60)):
        tag = rng.choice(["a", "a", "h1", "h2", "div", "p", "form", "li", "b"])
        out.append(
            rng.choice(
                [f'<{tag} href="{i}" action="{i}">', f"</{tag}>", f"t{i} ", f'<{tag} href="{i}" action="{i}"/>', f'<input name="{i}">', "<br>", f'<select name="{i}"></select>', "</br>", " &amp; "]
            )
        )
    return "".join(out)


def test_random_soup_equals_a_plain_tree(spark):
    pages = [(i, "https://example.com/", soup(i)) for i in range(150)]
    df = pages_of(spark, pages).repartition(4)
    links, heads, fields = {}, {}, {}
    for r in X.links(df).orderBy("page_id", "ord").collect():
        links.setdefault(r["page_id"], []).append((r["target_url"], r["anchor_text"]))
    for r in X.headings(df).orderBy("page_id", "level", "ord").collect():
        heads.setdefault(r["page_id"], []).append((r["level"], r["text"]))
    for r in X.forms(df).collect():
        for f in r["fields"]:
            fields.setdefault(r["page_id"], []).append((f["name"], r["action"]))
    for i, _, html in pages:
        t = read(html)
        assert links.get(i, []) == [(e["attrs"]["href"], e["text"].strip()) for e in t.found if e["tag"] == "a" and e["attrs"].get("href")]
        want = [(e["tag"], e["text"].strip()) for n in ("h1", "h2") for e in t.found if e["tag"] == n]
        assert heads.get(i, []) == want
        assert sorted(fields.get(i, [])) == sorted((n, f) for n, f in t.fields if f is not None)


def test_intervals_nest():
    close, upto, forms, fields = intervals("div a form/ p/ a /a input /div b form input form select /form input".split())
    assert close == [7, 7, 2, 3, 5, -1, 6, -1, 15, 15, 10, 13, 13, -1, 14]
    assert upto == [7, 4, 2, 3, 5, -1, 6, -1, 15, 11, 10, 13, 13, -1, 14]
    assert (forms, fields) == ([2, 9, 11], [[], [10, 14], [12]])
    assert intervals([]) == ([], [], [], [])


@pytest.mark.parametrize("markup", ['<div><a href="x">t', '<h2>t<form action="x"><input name="n">', "<!-- <script>"])
def test_unclosed_tags_take_linear_time(spark, markup):
    """20 000 unclosed tags are read in seconds, and twice as many in about twice the time."""

    def took(n):
        df = pages_of(spark, [(1, "https://example.com/", markup * n)])
        start = time.time()
        rows = [d.agg(F.count("*"), F.max(F.xxhash64(*d.columns))).first()[0] for d in (X.links(df), X.headings(df), X.form_fields(X.forms(df)))]
        return time.time() - start, rows

    took(100)
    short, _ = took(20_000)
    long, rows = took(40_000)
    assert long < 20 and long < 3 * short + 1, (short, long)
    assert rows == {"<d": [40_000, 0, 0], "<h": [0, 40_000, 40_000], "<!": [0, 0, 0]}[markup[:2]]


def test_null_and_empty_pages(spark):
    df = pages_of(spark, [(1, "https://example.com/", None), (2, "https://example.com/", ""), (3, "https://example.com/", "text")])
    assert X.links(df).count() == X.headings(df).count() == X.forms(df).count() == 0
