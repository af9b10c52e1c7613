"""Main text of a page by tree scoring (operator 9).

One pass over the markup builds the tree of block elements. Each paragraph-like block gives points
for its length and commas, discounted by its share of link text: all of them to its container,
half to the next ancestor, a third to the one above, and so on for REACH ancestors. The container with most points wins;
if an ``article``, else a ``main`` or an element with a whole name of CONTENT encloses it, that is taken
whole. Siblings of few links are kept with it, whatever their length; beside an article only those that score well. Menus, headers, footers, side bars, notices, adverts, forms, scripts
and reader comments are cut out of the tree by their element or by the names in class, id and role. Names never cut
``article``, ``main`` or an element with a whole name of CONTENT, nor a ``main`` inside what they cut; and a word that is only
a part of a name (sidebar-right, nav-fixed, menu-open) says little of a container that holds most of the page's unlinked text, or
an article or first heading: that stays. A pass over the tree takes time in proportion to its elements, however deep they lie.

Cases: null and empty html give an empty text; unclosed, mis-nested and cut-off markup is closed the
way browsers do it (a new paragraph ends the open one, an end tag without a start is ignored); repeated
rows are extracted each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|title|noscript|template|iframe|svg|xmp)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?:/>|>.*?(?:</(?P=raw)\s*+[^>]*+>|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CUT = frozenset("head nav footer aside form button select dialog menu object audio video canvas map".split())
BLOCKS = frozenset(
    "html body main article section div header hgroup p pre blockquote ul ol li dl dt dd table caption thead tbody "
    "tfoot tr td th figure figcaption address details summary center fieldset legend h1 h2 h3 h4 h5 h6".split()
)
LEAVES = frozenset("p pre blockquote li dd dt td th figcaption address h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag ends these open elements, searched up to the nearest boundary.
ENDS = {
    "li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",)),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)), "tfoot": (("thead", "tbody"), ("table",)),
}
#: Words of class, id or role that mark what is never main text, and those that do so unless a word of CONTENT is there too.
ALWAYS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent gdpr popup modal "
    "comment comments disqus respond replies sidebar navigation navbar nav menu breadcrumb breadcrumbs pagination pager "
    "newsletter subscribe footer complementary contentinfo alert notice notification".split()
)
MAYBE = frozenset("banner header masthead share sharing social related recommended recommendations widget toolbar tags search login signup aside meta byline".split())
CONTENT = frozenset("article content main post story entry text body".split())
#: First words of a name that tells how an element looks or is filed (no-sidebar, has-comments): it marks nothing.
STATES = frozenset("no not non with without has have is hide show category tag format layout template".split())


REACH = 32  # ancestors that a block's points reach
MOST = 0.75  # share of the page's unlinked text whose container no part of a name cuts


class Node:
    __slots__ = ("tag", "parent", "cut", "named", "holds", "out", "score", "depth", "good", "marked", "chars", "linked", "place")

    def __init__(self, tag: str, parent: Node | None, cut: bool, good: bool):
        self.tag, self.parent, self.cut, self.good = tag, parent, cut, good
        self.marked, self.chars, self.linked = False, 0, 0.0  # main or content by its name; text below and its links
        self.named = 0  # marked as no main text by a part of its name (1) or a whole name (2)
        self.holds = tag in ("article", "main", "h1")  # has an article or first heading
        self.out = False  # by its name, or by that of an element around it
        self.place: Node | None = None  # best container, or the child of the one above it, that holds this node
        self.score = 0.0
        self.depth = parent.depth + 1 if parent else 0


def is_cut(tag: str, attrs: str, in_article: bool) -> tuple[bool, int, bool, bool]:
    """(cut out by its element; by its names: 0 no, 1 by a part of one, 2 by a whole one; hinted as content; marked as content)."""
    words, names = set(), set()
    if "=" in attrs:
        for m in NAMED.finditer(attrs):
            for name in (m[1] or m[2] or m[3] or "").lower().split():
                names.add(name)
                parts = re.split(r"[^a-z]+", name)
                words.update(() if len(parts) > 1 and parts[0] in STATES else parts)
    good = bool(words & CONTENT) or tag in ("article", "main")
    if tag in ("html", "body"):
        return False, 0, good, False
    if tag in CUT or (tag == "header" and not in_article):
        return True, 0, False, False
    if tag in ("article", "main") or names & CONTENT:
        return False, 0, True, True
    bad = ALWAYS if good else ALWAYS | MAYBE
    return False, 2 if names & bad else 1 if words & bad else 0, good, False


class Page:
    """The tree of block elements, and the text blocks in page order."""

    def __init__(self, html: str, by_name: bool = True):
        self.root = Node("html", None, False, False)
        self.nodes = [self.root]  # parents before children
        self.blocks: list[tuple[Node, str, float]] = []
        self.open = [self.root]
        self.count: dict[str, int] = {}  # open elements by tag
        self.parts: list[str] = []
        self.linked = 0
        self.link = False
        at = 0
        for m in MARKUP.finditer(html):
            if m.start() > at:
                self.text(html[at : m.start()])
            at = m.end()
            if (tag := m["tag"]) is None:
                continue
            tag = tag.lower()
            if m["end"]:
                self.ended(tag)
            else:
                self.started(tag, m["attrs"] or "", by_name)
        self.text(html[at:])
        self.flush()

    def text(self, raw: str) -> None:
        if not self.open[-1].cut:
            self.parts.append(unescape(raw) if "&" in raw else raw)
            if self.link:
                self.linked += len(raw)

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append((self.open[-1], text, min(self.linked / len(text), 1.0)))
            self.parts, self.linked = [], 0

    def drop(self, i: int) -> None:
        """Close the open elements from number i on."""
        for node in self.open[i:]:
            self.count[node.tag] -= 1
        del self.open[i:]

    def close_to(self, tags: tuple[str, ...], stops: tuple[str, ...]) -> None:
        if not any(self.count.get(t) for t in tags):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                self.flush()
                self.drop(i)
                return
            if self.open[i].tag in stops:
                return

    def started(self, tag: str, attrs: str, by_name: bool) -> None:
        if tag in VOID:
            if tag == "hr":
                self.flush()
            elif tag == "br":
                self.parts.append(" ")
            return
        if tag == "a":
            self.link = True
        block = tag in BLOCKS or tag in CUT
        if not block and ("=" not in attrs or "-" in tag):
            return
        in_article = bool(self.count.get("article") or self.count.get("main"))
        cut, named, good, marked = is_cut(tag, attrs if by_name else "", in_article)
        if not block:  # a span or link inside a block: nothing of it is in the running text
            cut, named = bool(named), 0
            if not cut:
                return
        if block:
            self.flush()
            self.close_to(("p",), ())
            if tag in HEADINGS:
                self.close_to(tuple(HEADINGS), ("article", "section", "div"))
            if tag in ENDS:
                self.close_to(*ENDS[tag])
            self.link = False
        if tag in ("html", "body"):
            return
        top = self.open[-1]
        node = Node(tag, top, cut or top.cut, good)
        node.marked, node.named = marked, named
        self.nodes.append(node)
        self.open.append(node)
        self.count[tag] = self.count.get(tag, 0) + 1

    def ended(self, tag: str) -> None:
        if tag == "a":
            self.link = False
        if tag in ("html", "body") or not self.count.get(tag):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                if tag in BLOCKS or tag in CUT:
                    self.flush()
                self.drop(i)
                return
            if tag in LEAVES and self.open[i].tag not in LEAVES | {"ul", "ol", "dl"} and not self.open[i].cut:
                return

    def sums(self) -> None:
        """Text and link text below each node, from the leaves up."""
        for node in self.nodes:
            node.chars, node.linked = 0, 0.0
        for node, text, links in self.blocks:
            node.chars += len(text)
            node.linked += len(text) * links
        for node in reversed(self.nodes):
            if node.parent:
                node.parent.chars += node.chars
                node.parent.linked += node.linked
                node.parent.holds |= node.holds and not node.cut

    def leave_out(self) -> None:
        """Drop the blocks of elements whose names say that they are no main text."""
        if not any(node.named for node in self.nodes):
            return
        self.sums()
        most = MOST * (self.root.chars - self.root.linked)
        for node in self.nodes[1:]:
            bad = node.named == 2 or node.named == 1 and node.chars - node.linked <= most and not node.holds
            node.out = bad or node.parent.out and node.tag != "main"
        self.blocks = [b for b in self.blocks if not b[0].out]

    def score(self) -> None:
        self.sums()
        for node, text, links in self.blocks:
            if node.tag in HEADINGS:
                continue
            points = (len(text) / 100 + text.count(",")) * (1 - links)
            node = node.parent if node.tag in LEAVES and node.parent else node
            share = 1
            while node and share <= REACH:
                node.score += points / share * (1.25 if node.good else 1)
                node, share = node.parent, share + 1

    def main(self) -> str:
        self.leave_out()
        self.score()
        nodes = {}
        for node, _, _ in self.blocks:
            while node and id(node) not in nodes:
                nodes[id(node)] = node
                node = node.parent
        if not nodes:
            return ""
        best = max(nodes.values(), key=lambda n: (n.score, n.good, n.depth))
        around = []  # the best container and what encloses it
        node = best
        while node:
            around.append(node)
            node = node.parent
        articles = [n for n in around if n.tag == "article"]
        best = next(iter(articles or [n for n in around if n.marked and n.tag not in LEAVES]), best)
        for node in self.nodes:  # parents first
            beside = node.parent is not None and node.parent is best.parent
            node.place = node if node is best or beside else node.parent.place if node.parent else None
        kept = []
        for node, text, links in self.blocks:
            if node.place is best:
                kept.append(text)
            elif node.place or node is best.parent:
                if self.sibling(best, node.place, text, links):
                    kept.append(text)
        return "\n".join(kept)

    @staticmethod
    def sibling(best: Node, below: Node | None, text: str, links: float) -> bool:
        """Is a block beside the best container kept? ``below`` is the sibling that holds it, if any."""
        if below is not None and below.tag in HEADINGS:
            return best.tag != "article"
        if below is not None and below.tag not in LEAVES:
            if best.tag == "article":
                return below.score >= max(0.2 * best.score, 1.0) and below.tag != "ul"
            return below.linked < 0.25 * below.chars
        return best.tag != "article" and links < 0.25


def main_text(html: str | None) -> str:
    """The main text of a page, one line a block."""
    if not html:
        return ""
    return Page(html).main() or Page(html, by_name=False).main()


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text, n_chars for every row of ``pages``; each page is read inside its own row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["key", "url", "text", "n_chars"],
            )

    narrow = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    kind = narrow.schema["key"].dataType.simpleString()
    return narrow.mapInArrow(run, f"key {kind}, url string, text string, n_chars long").withColumnsRenamed({"key": key, "url": url})
