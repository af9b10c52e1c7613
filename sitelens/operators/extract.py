"""Page extraction operators (E1–E28, E32): ``pages → fact rows``.

Every function takes a conformed page DataFrame (``page_id, url, site, html``…)
and returns one fact table. All work happens inside each page's own row —
regex built-ins over the HTML and higher-order functions over the ``el`` element
array — followed by one ``explode``. No operator here shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions.lookups import (
    API_PATTERN,
    COMMENT_URL_PATTERN,
    EMAIL_PATTERN,
    FILE_EXTENSIONS,
    JS_URL_PATTERN,
    PHONE_PATTERNS,
    SOCIAL_PLATFORMS,
    TECH_FINGERPRINTS,
)
from sitelens.functions.patterns import holds_any, literals_of, names_matched
from sitelens.functions.text import decode_entities, let, node_text
from sitelens.functions.urls import in_scope, resolve
from sitelens.operators.containment import HEADINGS, contained
from sitelens.operators.elements import (
    SCRIPT_BLANK_RE,
    STYLE_BLANK_RE,
    TAG_RE,
    _Q,
    attr,
    element_array,
    has_attr,
    mask_html,
    of_tag,
    start_tags,
    tag_attrs,
    tags_in,
    title_text,
)


def el_col() -> Column:
    """The element array column (built lazily: no session needed at import)."""
    return F.col("el")


def ensure_elements(pages: DataFrame) -> DataFrame:
    return pages if "el" in pages.columns else pages.withColumn("el", element_array(F.col("html")))


def masked_of(df: DataFrame) -> Column:
    """The masked markup: column ``_m`` when the caller already built it."""
    return F.col("_m") if "_m" in df.columns else mask_html(F.col("html"))


def tags_of(df: DataFrame, *names: str, attrs: tuple = ()) -> Column:
    """Start tags by name: from ``el`` when the caller already built it (shared
    across extractors), else a targeted scan of just those tags (and ``attrs``)."""
    if "el" in df.columns:
        return of_tag(el_col(), *names)
    return tags_in(masked_of(df), *names, attrs=attrs)


def _rows(df: DataFrame, name: str, build) -> DataFrame:
    """``df`` with the facts of each page in column ``name``, which a caller may have built already (see ``page_rows``)."""
    return df if name in df.columns else build(df)


def with_tags(df: DataFrame, *names: str, attrs: tuple = ()) -> DataFrame:
    """``df`` with column ``el``, so that the tags are read once however often they are asked."""
    return df if "el" in df.columns else df.withColumn("el", start_tags(F.col("html"), *names, attrs=attrs))


def _first(arr: Column) -> Column:
    return F.try_element_at(arr, F.lit(1))


# ---- E1–E8: metadata --------------------------------------------------------------

def _last_wins_map(entries: Column) -> Column:
    """map_from_entries with last-duplicate-wins, independent of session policy."""

    def by_key(found: Column) -> Column:
        keys = F.array_distinct(F.transform(found, lambda x: x["k"]))
        return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("k"), _last_of(found, k).alias("v"))))

    return let(entries, by_key)


def _last_of(entries: Column, key: Column) -> Column:
    return F.try_element_at(F.filter(entries, lambda x: x["k"] == key), F.lit(-1))["v"]


META_ATTRS = ("name", "property", "content", "rel", "href", "lang")


def metadata(pages: DataFrame, keep: list = ()) -> DataFrame:
    """One row per page with title, meta map, description, keywords,
    Open Graph and Twitter maps, canonical link and language (and the columns to ``keep``)."""
    masked = pages.select("page_id", "url", "site", *keep, masked_of(pages).alias("_m"))
    kept = [c for c in masked.columns if c not in ("page_id", "url", "site", "_m")]
    el = masked.select("page_id", "url", "site", *kept, title_text(F.col("_m")).alias("_title"), tags_in(F.col("_m"), "meta", "link", "html", attrs=META_ATTRS).alias("el"))

    def meta(e: Column) -> Column:
        named = F.struct(attr(e, "name").alias("name"), attr(e, "property").alias("property"), F.coalesce(attr(e, "content"), F.lit("")).alias("content"))
        # tag.get('name', tag.get('property', '')): a present-but-empty name wins.
        return let(named, lambda m: F.struct(F.lower(F.coalesce(m["name"], m["property"], F.lit(""))).alias("k"), m["content"].alias("v"), m["name"], m["property"]))

    # an attribute is looked up once, however many facts ask for it
    df = el.withColumn("_metas", F.transform(of_tag(el_col(), "meta"), meta))
    metas = F.col("_metas")
    meta_entries = F.filter(metas, lambda m: (m["k"] != "") & (m["v"] != ""))

    def content_of(*ways) -> Column:
        found = F.coalesce(*[_first(F.filter(metas, way)) for way in ways])
        return F.coalesce(found["v"], F.lit(""))

    def prefixed(name: str, prefix: str) -> Column:
        found = F.filter(metas, lambda m: F.coalesce(m[name], F.lit("")).startswith(prefix))
        return F.transform(found, lambda m: F.struct(m[name].alias("k"), m["v"].alias("v")))

    canon_el = _first(
        F.filter(
            of_tag(el_col(), "link"),
            lambda e: F.array_contains(F.split(F.coalesce(attr(e, "rel"), F.lit("")), r"\s+"), "canonical"),
        )
    )
    html_el = _first(of_tag(el_col(), "html"))
    return df.select(
        "page_id",
        "url",
        "site",
        *kept,
        F.col("_title").alias("seo_title"),
        F.coalesce(_last_of(meta_entries, F.lit("title")), F.col("_title")).alias("title"),
        _last_wins_map(F.transform(meta_entries, lambda m: F.struct(m["k"], m["v"]))).alias("meta"),
        content_of(lambda m: m["name"] == "description", lambda m: m["property"] == "og:description").alias("description"),
        content_of(lambda m: m["name"] == "keywords").alias("keywords"),
        _last_wins_map(prefixed("property", "og:")).alias("open_graph"),
        _last_wins_map(prefixed("name", "twitter:")).alias("twitter"),
        F.coalesce(attr(canon_el, "href"), F.lit("")).alias("canonical"),
        F.coalesce(attr(html_el, "lang"), F.lit("")).alias("language"),
    )


def _page_elements(pages: DataFrame, kind: str) -> DataFrame:
    """``pages`` with the elements of a kind in ``_in``, read already or now."""
    return pages if "_in" in pages.columns else contained(pages.withColumn("_m", masked_of(pages)), "_m", kind)


def headings(pages: DataFrame) -> DataFrame:
    """(page_id, level, ord, text) for h1..h6; ``ord`` is the position within its level."""
    # texts are cut in the page's row: behind an explode each row would carry all runs of its page
    texts = F.transform("_in.heads", lambda e: F.struct(e["tag"].alias("level"), node_text(e["text"]).alias("text")))
    df = _page_elements(pages, "heads").select("page_id", "url", "site", texts.alias("h"))

    def level(name: str) -> Column:
        return F.transform(F.filter("h", lambda e: e["level"] == name), lambda e, i: F.struct(i.alias("ord"), e.alias("e")))

    out = df.select("page_id", "url", "site", F.explode(F.concat(*map(level, HEADINGS))).alias("h"))
    return out.select("page_id", "url", "site", "h.e.level", "h.ord", "h.e.text")


def h1_texts() -> Column:
    return F.transform(F.filter("_in.heads", lambda e: e["tag"] == "h1"), lambda e: node_text(e["text"]))


def with_h1(pages: DataFrame, masked: str, name: str) -> DataFrame:
    """``pages`` with the texts of its h1 elements (of the markup in column ``masked``)."""
    return contained(pages, masked, "heads").withColumn(name, h1_texts()).drop("_in")


# ---- E10, E11: e-mails and phone numbers over the raw response text -----------------

def emails(pages: DataFrame, text_col: str = "html") -> DataFrame:
    m = F.regexp_extract_all(F.col(text_col), F.lit(EMAIL_PATTERN), 0)
    return pages.select("page_id", "url", "site", F.posexplode(m).alias("pos", "email"))


def phones(pages: DataFrame, text_col: str = "html") -> DataFrame:
    """Four patterns applied in order and concatenated (a number may repeat)."""
    def tagged(i: int, p: str) -> Column:
        return F.transform(
            F.regexp_extract_all(F.col(text_col), F.lit(p), 0),
            lambda x: F.struct(F.lit(i).alias("pattern"), x.alias("phone")),
        )

    parts = [tagged(i, p) for i, p in enumerate(PHONE_PATTERNS, start=1)]
    out = pages.select("page_id", "url", "site", F.posexplode(F.concat(*parts)).alias("pos", "m"))
    return out.select("page_id", "url", "site", "pos", "m.pattern", "m.phone")


# ---- E12: social links ------------------------------------------------------------

def _a_hrefs(el: Column | None = None) -> Column:
    """``find_all('a', href=True)`` as structs (seq, href, anchor element)."""
    el = el_col() if el is None else el
    return F.filter(of_tag(el, "a"), lambda e: has_attr(e, "href"))


def social_links(pages: DataFrame, platforms: list[tuple[str, str]] = SOCIAL_PLATFORMS) -> DataFrame:
    """Every anchor's link by platform, by (platform, pattern) ``platforms``; a link may match several."""
    anchors = F.filter(tags_of(pages, "a", attrs=("href",)), lambda e: has_attr(e, "href"))
    links = pages.select("page_id", "url", "site", F.explode(F.transform(anchors, lambda e: attr(e, "href"))).alias("href"))
    # Resolve once in its own projection: expressions holding higher-order
    # functions are not shared by subexpression elimination, and the resolved
    # link is tested against every platform.
    resolved = links.select("page_id", "url", "site", resolve(F.col("url"), F.col("href")).alias("link"))
    hits = F.array_compact(F.array(*names_matched(F.col("link"), F.col("_low"), platforms)))
    low = resolved.withColumn("_low", F.lower("link"))
    return low.select("page_id", "url", "site", "link", F.explode(hits).alias("platform"))


# ---- E13, E14: forms and fields (J11: field → enclosing form by position) ------------

FORM_ATTRS = ("action", "method", "type", "name", "id", "required")


def form_rows() -> Column:
    def field(tag: Column, x: Column) -> Column:
        return F.struct(
            F.coalesce(attr(x, "type"), tag).alias("type"),
            F.coalesce(attr(x, "name"), F.lit("")).alias("name"),
            F.coalesce(attr(x, "id"), F.lit("")).alias("id"),
            has_attr(x, "required").alias("required"),
        )

    def read(e: Column) -> Column:
        return F.struct(tag_attrs(e["attrs"], FORM_ATTRS).alias("attrs"))

    return F.transform(
        "_in.forms",
        lambda f: let(read(f), lambda form: F.struct(
            F.coalesce(attr(form, "action"), F.lit("")).alias("action"),
            F.upper(F.coalesce(attr(form, "method"), F.lit("get"))).alias("method"),
            F.transform(f["fields"], lambda e: let(read(e), lambda x: field(e["tag"], x))).alias("fields"),
        )),
    )


def forms(pages: DataFrame) -> DataFrame:
    """Each form with the fields whose innermost open form it is."""
    df = _rows(pages, "_forms", lambda p: _page_elements(p, "forms").withColumn("_forms", form_rows()))
    out = df.select("page_id", "url", "site", F.posexplode("_forms").alias("ord", "f"))
    return out.select("page_id", "url", "site", F.col("ord").alias("seq"), "ord", "f.action", "f.method", "f.fields")


def form_fields(forms_df: DataFrame) -> DataFrame:
    out = forms_df.select("page_id", "url", "site", F.col("ord").alias("form_ord"), F.posexplode("fields").alias("field_pos", "fl"))
    return out.select("page_id", "url", "site", "form_ord", "field_pos", "fl.type", "fl.name", "fl.id", "fl.required")


# ---- E15, E16, E17: images, videos, JSON-LD ----------------------------------------

def image_rows(df: DataFrame) -> Column:
    return F.transform(
        tags_of(df, "img", attrs=("src", "alt", "title", "width", "height")),
        lambda e: F.struct(
            e["seq"].alias("seq"),
            F.coalesce(attr(e, "src"), F.lit("")).alias("raw_src"),
            F.coalesce(attr(e, "alt"), F.lit("")).alias("alt"),
            F.coalesce(attr(e, "title"), F.lit("")).alias("title"),
            F.coalesce(attr(e, "width"), F.lit("")).alias("width"),
            F.coalesce(attr(e, "height"), F.lit("")).alias("height"),
        ),
    )


def images(pages: DataFrame) -> DataFrame:
    df = _rows(pages, "_images", lambda p: p.withColumn("_images", image_rows(p)))
    out = df.select("page_id", "url", "site", F.explode("_images").alias("i"))
    return out.select(
        "page_id", "url", "site", "i.seq", resolve(F.col("url"), F.col("i.raw_src")).alias("src"),
        "i.alt", "i.title", "i.width", "i.height",
    )


def videos(pages: DataFrame) -> DataFrame:
    df = pages
    rows = F.transform(
        tags_of(pages, "video", "iframe", attrs=("src",)),
        lambda e: F.struct(e["seq"].alias("seq"), F.coalesce(attr(e, "src"), F.lit("")).alias("src"), e["tag"].alias("type")),
    )
    out = df.select("page_id", "url", "site", F.explode(rows).alias("v"))
    src = F.col("v.src")
    platform = F.when(
        (F.col("v.type") == "iframe") & (src.contains("youtube.com") | src.contains("vimeo.com")),
        F.when(src.contains("youtube"), F.lit("youtube")).otherwise(F.lit("vimeo")),
    )
    return out.select("page_id", "url", "site", "v.seq", "v.src", "v.type", platform.alias("platform"))


SCRIPT_RE = rf"(?is)<script\b({_Q})>(.*?)(?:</script\s*>|\z)"


def _unmask_comments(html: Column) -> Column:
    """HTML with comments removed but script bodies kept (script text is raw)."""
    return F.regexp_replace(html, r"(?is)<!--.*?(?:-->|\z)|(<script\b" + _Q + r">.*?(?:</script\s*>|\z))", "$1")


def scripts(pages: DataFrame) -> DataFrame:
    """Inline script elements: (page_id, pos, type, body)."""
    src = _unmask_comments(F.col("html"))
    attrs = F.regexp_extract_all(src, F.lit(SCRIPT_RE), 1)
    bodies = F.regexp_extract_all(src, F.lit(SCRIPT_RE), 2)
    rows = F.transform(attrs, lambda a, i: F.struct(i.alias("pos"), a.alias("attrs"), F.get(bodies, i).alias("body")))
    out = pages.select("page_id", "url", "site", F.explode(rows).alias("s"))
    a = F.col("s.attrs")
    typ = F.regexp_extract(a, r"""(?i)(?:^|\s)type\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*))""", 0)
    type_val = F.regexp_replace(F.regexp_replace(typ, r"""(?i)^\s*type\s*=\s*""", ""), r"""^["']|["']$""", "")
    return out.select("page_id", "url", "site", "s.pos", decode_entities(type_val).alias("type"), "s.body")


def json_ld(pages: DataFrame) -> DataFrame:
    """``script[type=application/ld+json]`` bodies that parse as JSON."""
    s = scripts(pages).where(F.col("type") == "application/ld+json")
    v = F.try_parse_json(F.col("body"))
    return s.select("page_id", "url", "site", "pos", v.alias("data")).where(F.col("data").isNotNull())


# ---- E18: downloadable files (J9 ordered first match) ----------------------------

def file_type(href: Column, extensions: list[str] = FILE_EXTENSIONS) -> Column:
    """The first of ``extensions`` that the link contains, without its dot; null if none."""
    low = F.lower(href)
    expr = F.when(F.lit(False), F.lit(""))
    for ext in extensions:
        cond = low.contains(ext)
        expr = expr.when(cond, F.lit(ext[1:]))
    return expr


def anchor_rows(df: DataFrame) -> Column:
    anchors = F.filter(tags_of(df, "a", attrs=("href",)), lambda e: has_attr(e, "href"))
    return F.transform(anchors, lambda e: F.struct(e["seq"].alias("seq"), attr(e, "href").alias("href")))


def files(pages: DataFrame, extensions: list[str] = FILE_EXTENSIONS) -> DataFrame:
    df = _rows(pages, "_anchors", lambda p: p.withColumn("_anchors", anchor_rows(p)))
    out = df.select("page_id", "url", "site", F.explode("_anchors").alias("a"))
    return (
        out.select("page_id", "url", "site", "a.seq", file_type(F.col("a.href"), extensions).alias("file_type"),
                   resolve(F.col("url"), F.col("a.href")).alias("file_path"))
        .where(F.col("file_type").isNotNull())
    )


# ---- E19–E26: links and endpoints --------------------------------------------------

def link_rows() -> Column:
    found = F.transform(
        "_in.links",
        lambda e: F.struct(e.alias("e"), attr(F.struct(tag_attrs(e["attrs"], ("href",)).alias("attrs")), "href").alias("target_url")),
    )
    return F.transform(
        F.filter(found, lambda r: F.coalesce(r["target_url"], F.lit("")) != ""),
        lambda r: F.struct(r["target_url"], F.when(r["e"]["tag"] == "a", node_text(r["e"]["text"])).otherwise(F.lit("")).alias("anchor_text")),
    )


def links(pages: DataFrame) -> DataFrame:
    """E19 + F12: every a/link with a non-empty href; duplicates kept."""
    df = _rows(pages, "_links", lambda p: _page_elements(p, "links").withColumn("_links", link_rows()))
    out = df.select("page_id", F.col("url").alias("source_url"), "site", F.posexplode("_links").alias("ord", "l"))
    return out.select(
        "page_id", "source_url", "site", "ord", "l.target_url", "l.anchor_text",
        F.when(F.instr(F.col("l.target_url"), F.col("site")) > 0, F.lit("internal")).otherwise(F.lit("external")).alias("link_type"),
    )


def script_strings(html: Column) -> Column:
    """Bodies of non-empty inline scripts (comments outside scripts removed)."""
    bodies = F.regexp_extract_all(_unmask_comments(html), F.lit(SCRIPT_RE), 2)
    return F.filter(bodies, lambda b: b != "")


def comment_bodies(html: Column) -> Column:
    no_code = F.regexp_replace(F.regexp_replace(html, SCRIPT_BLANK_RE, "$1$2"), STYLE_BLANK_RE, "$1$2")
    return F.regexp_extract_all(no_code, F.lit(r"(?s)<!--(.*?)(?:-->|\z)"), 1)


def candidate_array(el: Column, html: Column) -> Column:
    """E20–E23 as one per-page array<struct<kind, raw>> (not yet distinct).
    ``el`` may be the full element array or just the a/link/script/img/form tags."""

    def attr_values(tags, name, kind):
        vals = F.transform(of_tag(el, *tags), lambda e: attr(e, name))
        return F.transform(F.filter(vals, lambda v: F.coalesce(v, F.lit("")) != ""), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("raw")))

    def kinded(arr, kind):
        return F.transform(arr, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("raw")))

    def in_scripts(bodies):
        js_urls = F.flatten(F.transform(bodies, lambda s: F.regexp_extract_all(s, F.lit(JS_URL_PATTERN), 1)))
        api = F.flatten(F.transform(bodies, lambda s: F.regexp_extract_all(s, F.lit(API_PATTERN), 0)))
        api = F.transform(api, lambda x: F.regexp_replace(x, r"""^["']+|["']+$""", ""))
        return F.concat(kinded(js_urls, "js"), kinded(api, "api"))

    comments = comment_bodies(html)
    com_urls = F.flatten(F.transform(comments, lambda c: F.regexp_extract_all(c, F.lit(COMMENT_URL_PATTERN), 0)))

    return F.concat(
        attr_values(("a", "link"), "href", "href"),
        attr_values(("script",), "src", "script"),
        attr_values(("img",), "src", "img"),
        attr_values(("form",), "action", "form"),
        let(script_strings(html), in_scripts),
        kinded(com_urls, "comment"),
    )


ENDPOINT_TAGS = ("a", "link", "script", "img", "form")
ENDPOINT_ATTRS = ("href", "src", "action")


def endpoint_candidates(pages: DataFrame) -> DataFrame:
    """Raw candidates per page with their origin kind (not yet distinct)."""
    tagged = with_tags(pages, *ENDPOINT_TAGS, attrs=ENDPOINT_ATTRS)
    out = tagged.select("page_id", "url", "site", F.explode(candidate_array(el_col(), F.col("html"))).alias("c"))
    return out.select("page_id", "url", "site", "c.kind", "c.raw")


def in_scope_of(found: Column, url: Column, site: Column) -> Column:
    """Distinct resolved in-scope endpoints (E24, E25) of a page's candidates."""
    raws = F.array_distinct(F.transform(F.filter(found, lambda c: c["raw"] != ""), lambda c: c["raw"]))
    resolved = F.array_compact(F.array_distinct(F.transform(raws, lambda r: resolve(url, r))))
    return F.filter(resolved, lambda u: in_scope(u, site))


def endpoints(pages: DataFrame) -> DataFrame:
    """Distinct resolved endpoints per page with the scope flag.

    The per-page "set" is an ``array_distinct`` inside the row (before and
    after resolution), so this is map-only: no shuffle."""
    tagged = with_tags(pages, *ENDPOINT_TAGS, attrs=ENDPOINT_ATTRS)
    raws = F.array_distinct(
        F.transform(F.filter(candidate_array(el_col(), F.col("html")), lambda c: c["raw"] != ""), lambda c: c["raw"])
    )
    resolved = F.array_compact(F.array_distinct(F.transform(raws, lambda r: resolve(F.col("url"), r))))
    out = tagged.select("page_id", "url", "site", F.explode(resolved).alias("endpoint"))
    return out.withColumn("in_scope", in_scope(F.col("endpoint"), F.col("site")))


def api_endpoints(pages: DataFrame) -> DataFrame:
    return endpoint_candidates(pages).where(F.col("kind") == "api").select("page_id", "url", "site", F.col("raw").alias("api"))


# ---- E27, E28: technologies ------------------------------------------------------

def with_technologies(pages: DataFrame, fingerprints: list[tuple[str, str]] = TECH_FINGERPRINTS) -> DataFrame:
    """``pages`` with the distinct technologies of each in ``_techs``."""
    lines = F.transform(F.map_entries(F.coalesce(F.col("headers"), F.create_map().cast("map<string,string>"))), lambda h: F.concat(h["key"], F.lit(": "), h["value"]))
    df = pages.withColumn("_lines", lines)
    df = df.withColumns({"_low": F.lower("html"), "_head": F.lower(F.array_join("_lines", "\n"))})
    html_hits = names_matched(F.col("html"), F.col("_low"), fingerprints)

    def header_hit(name: str, pattern: str) -> Column:
        """A header matches; a page none of whose headers holds a literal of the pattern is not asked."""
        known = literals_of(pattern)
        some = F.exists("_lines", lambda h: h.rlike("(?i)" + pattern))
        return F.when(some if known is None else holds_any(F.col("_head"), known) & some, F.lit(name))

    hdr_hits = [header_hit(t, p) for t, p in fingerprints]
    # distinct, without nulls, and no higher-order function, which would have all of these evaluated outside generated code
    techs = F.array_except(F.array(*html_hits, *hdr_hits), F.array(F.lit(None).cast("string")))
    return df.withColumn("_techs", techs).drop("_lines", "_low", "_head")


def technologies(pages: DataFrame, fingerprints: list[tuple[str, str]] = TECH_FINGERPRINTS) -> DataFrame:
    """E27 + E28: distinct technologies per page from the HTML and the headers, by (name, pattern) ``fingerprints``."""
    df = _rows(pages, "_techs", lambda p: with_technologies(p, fingerprints))
    return df.select("page_id", "url", "site", F.explode("_techs").alias("technology"))


# ---- several kinds of facts of a page at once --------------------------------------------

def page_rows(pages: DataFrame, keep: list = ()) -> DataFrame:
    """One row a page with its metadata, ``_h1`` texts and the facts of ``links``, ``forms``, ``images``, ``files`` and ``technologies``
    as arrays (and the columns to ``keep``), from one masking and one pass over its tags. Those extractors take the result
    for ``pages``."""
    techs = with_technologies(pages)
    masked = techs.withColumn("_m", mask_html(F.col("html")))
    read = contained(masked, "_m", "links", "heads", "forms")
    rows = {"_h1": h1_texts(), "_links": link_rows(), "_forms": form_rows(), "_images": image_rows(read), "_anchors": anchor_rows(read)}
    return metadata(read, keep=[*keep, "_techs", *[c.alias(name) for name, c in rows.items()]])


# ---- E32: page text --------------------------------------------------------------

def page_text(pages: DataFrame, limit: int = 10000) -> DataFrame:
    """E32 + F18: visible text (no script/style/comment text), first ``limit`` chars."""
    txt = F.regexp_replace(mask_html(F.col("html")), TAG_RE + r"|<![^>]*>|<\?[^>]*>", "")
    # Own projection first: the decode refers to its input several times and
    # expressions with higher-order functions are not shared between uses.
    stripped = pages.select("page_id", "url", "site", txt.alias("_t"))
    return stripped.select("page_id", "url", "site", F.left(decode_entities(F.col("_t")), F.lit(limit)).alias("text"))
