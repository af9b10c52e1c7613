"""SEO audit (Q1–Q10): one flat row per page, computed inside the page row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.functions.lookups import SEO_DESCRIPTION_RANGE, SEO_MAX_PAGE_BYTES, SEO_MAX_SECONDS, SEO_TITLE_RANGE
from sitelens.operators.elements import attr, has_attr, mask_html, of_tag, tags_in, title_text
from sitelens.operators.extract import _first, el_col, with_h1
from sitelens.sources.pages import page_bytes


def seo(pages: DataFrame) -> DataFrame:
    masked = pages.withColumn("_m", mask_html(F.col("html")))
    df = with_h1(masked, "_m", "_h1").withColumns({
        "_title": title_text(F.col("_m")),
        "el": tags_in(F.col("_m"), "meta", "img", "a", attrs=("name", "content", "alt", "href")),
    })
    title = F.col("_title")
    desc_el = _first(F.filter(of_tag(el_col(), "meta"), lambda e: attr(e, "name") == "description"))
    desc = F.when(desc_el.isNull(), F.lit("")).otherwise(F.coalesce(attr(desc_el, "content"), F.lit("")))
    imgs = of_tag(el_col(), "img")
    n_img = F.size(imgs)
    no_alt = F.size(F.filter(imgs, lambda e: F.coalesce(attr(e, "alt"), F.lit("")) == ""))
    anchors = F.filter(of_tag(el_col(), "a"), lambda e: has_attr(e, "href"))
    internal = F.size(F.filter(anchors, lambda e: F.instr(attr(e, "href"), F.col("site")) > 0))
    size = F.coalesce(F.col("size"), page_bytes()) if "size" in df.columns else page_bytes()
    h1 = F.col("_h1")
    out = df.select(
        "page_id",
        "url",
        "site",
        title.alias("title_text"),
        desc.alias("description_text"),
        h1.alias("h1_texts"),
        n_img.alias("images_total"),
        no_alt.alias("images_without_alt"),
        size.alias("page_bytes"),
        F.col("elapsed").alias("response_seconds"),
        F.col("url").startswith("https").alias("https"),
        F.exists(of_tag(el_col(), "meta"), lambda e: F.coalesce(attr(e, "name") == "viewport", F.lit(False))).alias("mobile_friendly"),
        F.size(anchors).alias("links_total"),
        internal.alias("links_internal"),
    )
    lo_t, hi_t = SEO_TITLE_RANGE
    lo_d, hi_d = SEO_DESCRIPTION_RANGE
    return out.select(
        "page_id", "url", "site",
        "title_text",
        F.length("title_text").alias("title_length"),
        F.length("title_text").between(lo_t, hi_t).alias("title_optimal"),
        "description_text",
        F.length("description_text").alias("description_length"),
        F.length("description_text").between(lo_d, hi_d).alias("description_optimal"),
        F.size("h1_texts").alias("h1_count"),
        "h1_texts",
        (F.size("h1_texts") == 1).alias("h1_optimal"),
        "images_total",
        "images_without_alt",
        F.when(F.col("images_total") > 0,
               (F.col("images_total") - F.col("images_without_alt")) / F.col("images_total") * 100).otherwise(F.lit(0.0)).alias("alt_percentage"),
        "page_bytes",
        (F.col("page_bytes") / 1024).alias("page_kb"),
        (F.col("page_bytes") < SEO_MAX_PAGE_BYTES).alias("page_size_optimal"),
        "response_seconds",
        (F.col("response_seconds") < SEO_MAX_SECONDS).alias("response_time_optimal"),
        "https",
        "mobile_friendly",
        "links_total",
        "links_internal",
        (F.col("links_total") - F.col("links_internal")).alias("links_external"),
    )
