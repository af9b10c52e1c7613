"""Site statistics (A3, A4, A20): one row per site from a single pass over the HTML.

Every page contributes a small fact vector (counts and the values whose
distinct number is wanted); one partial/final aggregation over
``(site, kind, value)`` yields all statistics at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.functions.text import let
from sitelens.operators import extract as X
from sitelens.operators import keywords as K
from sitelens.sources.pages import page_bytes

STAT_NAMES = [
    "total_urls_visited", "total_endpoints_found", "total_subdomains_found", "total_keywords", "unique_emails",
    "unique_phones", "forms_found", "images_found", "videos_found", "files_found", "api_endpoints",
    "total_crawl_time", "average_response_time", "min_response_time", "max_response_time", "average_page_size",
    "total_data_downloaded", "peak_queue_size",
]


def page_fact_rows(pages: DataFrame, keep: tuple = ()) -> DataFrame:
    """One pass over each page's HTML: every fact the statistics need, as
    ``(site, kind, value, n)`` rows, with the columns to ``keep``. Distinct kinds carry the value; count kinds
    carry ``n`` with a NULL value."""
    from sitelens.functions.lookups import EMAIL_PATTERN, PHONE_PATTERNS
    from sitelens.operators.elements import attr, of_tag

    # Every fact here needs start-tag attributes only: one targeted scan (or
    # the caller's element array when it already built one), in a column of its own
    # since each fact asks it.
    p = X.with_tags(pages, *X.ENDPOINT_TAGS, "video", "iframe", attrs=X.ENDPOINT_ATTRS)
    el = X.el_col()
    html = F.col("html")

    def distinct_kind(kind: str, arr) -> F.Column:
        return F.transform(arr, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"), F.lit(1).cast("bigint").alias("n")))

    def count_kind(kind: str, n) -> F.Column:
        return F.array(F.struct(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("value"), n.cast("bigint").alias("n")))

    words = F.filter(F.array_distinct(K.tokens(html)), lambda w: K.keep_keyword(w))
    emails = F.regexp_extract_all(html, F.lit(EMAIL_PATTERN), 0)
    phones = F.concat(*[F.regexp_extract_all(html, F.lit(ph), 0) for ph in PHONE_PATTERNS])
    # candidates are found once and used for the endpoints and for the API set
    both = let(
        X.candidate_array(el, html),
        lambda found: F.struct(
            X.in_scope_of(found, F.col("url"), F.col("site")).alias("eps"),
            F.transform(F.filter(found, lambda c: c["kind"] == "api"), lambda c: c["raw"]).alias("api"),
        ),
    )
    p = p.withColumn("_found", both)
    eps, api = F.col("_found.eps"), F.col("_found.api")
    files = F.filter(X._a_hrefs(el), lambda e: X.file_type(attr(e, "href")).isNotNull())
    facts = F.concat(
        count_kind("pages", F.lit(1)),
        count_kind("bytes", page_bytes()),
        count_kind("forms", F.size(of_tag(el, "form"))),
        count_kind("images", F.size(of_tag(el, "img"))),
        count_kind("videos", F.size(of_tag(el, "video", "iframe"))),
        count_kind("files", F.size(files)),
        distinct_kind("keywords", words),
        distinct_kind("emails", emails),
        distinct_kind("phones", phones),
        distinct_kind("endpoints", eps),
        distinct_kind("api", api),
    )
    return p.select("site", *keep, F.explode(facts).alias("f")).select("site", *keep, "f.kind", "f.value", "f.n")


FACT_TO_STAT = {
    "pages": "total_urls_visited", "endpoints": "total_endpoints_found", "keywords": "total_keywords",
    "emails": "unique_emails", "phones": "unique_phones", "forms": "forms_found", "images": "images_found",
    "videos": "videos_found", "files": "files_found", "api": "api_endpoints", "bytes": "total_data_downloaded",
}


# ---- facts and sketches that a run stores, so that later runs can be merged with it --------

def count_facts(facts: DataFrame) -> DataFrame:
    """(site, stat, value) of page facts (site, url, kind, value, n): the statistics of one run, or of the merged ones."""
    per_value = facts.groupBy("site", "kind", "value").agg(F.sum("n").alias("n"))
    per_kind = per_value.groupBy("site", "kind").agg(F.when(F.bool_or(F.col("value").isNull()), F.sum("n")).otherwise(F.count("value")).alias("value"))
    return _named(per_kind)


def sketch_facts(facts: DataFrame, lg_k: int = 12) -> DataFrame:
    """(site, kind, sketch): an HLL sketch of 2^lg_k registers for each kind, whatever the number of pages. Counts are sketched
    as the ordinals of each page's items, so that a page of two runs counts once. Bytes cannot be sketched."""
    items = facts.where("kind <> 'bytes'").select(
        "site", "kind",
        F.explode(F.when(F.col("value").isNotNull(), F.array("value")).otherwise(
            F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.col("n")), lambda i: i > 0), lambda i: F.concat_ws(" ", i.cast("string"), "url"))
        )).alias("item"),
    )
    return items.groupBy("site", "kind").agg(F.hll_sketch_agg("item", lg_k).alias("sketch"))


def merge_sketches(*runs: DataFrame) -> DataFrame:
    """The sketch of all runs together, of each site and kind."""
    all_ = runs[0]
    for run in runs[1:]:
        all_ = all_.unionByName(run)
    return all_.groupBy("site", "kind").agg(F.hll_union_agg("sketch").alias("sketch"))


def count_sketches(sketches: DataFrame) -> DataFrame:
    """(site, stat, value) as the sketches estimate them: with 2^lg_k registers the standard error is 1.04 / 2^(lg_k / 2)."""
    return _named(sketches.select("site", "kind", F.hll_sketch_estimate("sketch").alias("value")))


def _named(per_kind: DataFrame) -> DataFrame:
    names = F.create_map(*[F.lit(x) for pair in FACT_TO_STAT.items() for x in pair])
    return per_kind.select("site", F.element_at(names, F.col("kind")).alias("stat"), F.col("value").cast("long").alias("value"))


def site_statistics(pages: DataFrame, subdomains: DataFrame | None = None, fetches: DataFrame | None = None,
                    peak_queue: DataFrame | None = None, approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """The statistics block of the result document, per site.

    One pass over the HTML (``page_fact_rows``); then a partial/final
    ``groupBy(site, kind, value)`` — the only large shuffle, carrying distinct
    values per site — and small per-site rollups.
    """
    f = page_fact_rows(pages)
    if approx:
        # A3 opt-in: HyperLogLog++ sketches merge map-side, so the shuffle carries
        # one small sketch per (task, site, kind) instead of every distinct value.
        per_kind = f.groupBy("site", "kind").agg(
            F.when(F.bool_or(F.col("value").isNull()), F.sum("n"))
            .otherwise(F.approx_count_distinct("value", rsd)).alias("v")
        )
    else:
        per_value = f.groupBy("site", "kind", "value").agg(F.sum("n").alias("n"))
        per_kind = per_value.groupBy("site", "kind").agg(
            # count kinds have one NULL-valued row per site; distinct kinds never NULL
            F.when(F.bool_or(F.col("value").isNull()), F.sum("n")).otherwise(F.count("value")).alias("v")
        )
    wide = per_kind.groupBy("site").pivot("kind", list(FACT_TO_STAT)).agg(F.first("v"))
    for kind, stat in FACT_TO_STAT.items():
        wide = wide.withColumnRenamed(kind, stat)
    out = wide.withColumn("average_page_size", F.col("total_data_downloaded") / F.col("total_urls_visited"))
    if subdomains is not None:
        out = out.join(subdomains.groupBy("site").agg(F.count_distinct("subdomain").alias("total_subdomains_found")), "site", "left")
    if fetches is not None:
        from sitelens.operators import fetch as FT

        out = out.drop("average_page_size", "total_data_downloaded").join(FT.timing(fetches), "site", "left").join(
            FT.duration(fetches), "site", "left"
        )
    if peak_queue is not None:
        out = out.join(peak_queue, "site", "left")
    # A statistic whose input was passed is 0 where the site has no such row; without its
    # input it is unknown.
    known = set(out.columns)
    measured = [F.coalesce(F.col(c), F.lit(0)).alias(c) if c in known else F.lit(None).cast("double").alias(c) for c in STAT_NAMES]
    return out.select("site", *measured)


def to_long(stats: DataFrame) -> DataFrame:
    """(site, stat, value double) rows — the shape merges and reports use."""
    pairs = F.array(*[F.struct(F.lit(c).alias("stat"), F.col(c).cast("double").alias("value")) for c in STAT_NAMES])
    return stats.select("site", F.explode(pairs).alias("p")).select("site", "p.stat", "p.value")
