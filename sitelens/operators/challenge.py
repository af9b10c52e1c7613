"""Challenge (captcha) pages: detection F13, provider F14, site key F15, drop F16."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions.lookups import CHALLENGE_MARKERS_BLOCKED, CHALLENGE_MARKERS_OK


def is_challenge(status: Column, html: Column) -> Column:
    """200 → any OK marker; 403/503 → at least two blocked-page markers (overlapping
    markers count separately); anything else → false."""
    low = F.lower(F.coalesce(html, F.lit("")))
    any_ok = reduce(lambda a, b: a | b, [low.contains(m) for m in CHALLENGE_MARKERS_OK])
    hits = reduce(lambda a, b: a + b, [low.contains(m).cast("int") for m in CHALLENGE_MARKERS_BLOCKED])
    return (
        F.when(status == 200, any_ok)
        .when(status.isin(403, 503), hits >= 2)
        .otherwise(F.lit(False))
    )


def provider(html: Column) -> Column:
    low = F.lower(F.coalesce(html, F.lit("")))
    return (
        F.when(low.contains("recaptcha"), F.lit("recaptcha"))
        .when(low.contains("hcaptcha") | low.contains("h-captcha"), F.lit("hcaptcha"))
        .when(low.contains("cloudflare"), F.lit("cloudflare"))
    )


def site_key(html: Column, prov: Column) -> Column:
    data_key = F.nullif(F.regexp_extract(html, r'data-sitekey="([^"]+)"', 1), F.lit(""))
    json_key = F.nullif(F.regexp_extract(html, r'"sitekey":"([^"]+)"', 1), F.lit(""))
    return (
        F.when(prov == "recaptcha", F.coalesce(data_key, json_key))
        .when(prov == "hcaptcha", data_key)
    )


def classify(pages: DataFrame) -> DataFrame:
    """Adds ``is_challenge``, ``provider`` and ``sitekey`` (the latter two only for challenge pages)."""
    chal = is_challenge(F.col("status_code"), F.col("html"))
    prov = F.when(chal, provider(F.col("html")))
    return (
        pages.withColumn("is_challenge", chal)
        .withColumn("provider", prov)
        .withColumn("sitekey", site_key(F.col("html"), F.col("provider")))
    )


def drop_challenges(pages: DataFrame) -> DataFrame:
    """F16: challenge pages are visited but yield no result row (no solver)."""
    return pages.where(~is_challenge(F.col("status_code"), F.col("html")))
