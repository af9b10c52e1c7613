"""Keyword extraction (E29–E31), per-page and per-site frequencies (A1, A2) and
top-k (T1, T2).

Tokenising and filtering are column expressions over the raw HTML (map-only).
Counting shuffles only pre-aggregated ``(page, word, n)`` / ``(site, word, n)``
rows: the partial aggregate runs map-side before the exchange. Top-k uses
``row_number() <= k`` which Spark plans as a partial ``WindowGroupLimit`` before
the shuffle, so even a site holding a third of all pages sends at most k rows
per map task to the final ranking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions.lookups import KEYWORD_MIN_LENGTH, KEYWORDS_PER_PAGE, STOP_WORDS

WORD_RE = r"[\p{L}\p{N}_]+"


def tokens(html: Column) -> Column:
    """Tags deleted (text glues across them), lower-cased, word runs."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(html, r"<[^>]+>", "")), F.lit(WORD_RE), 0)


def is_gibberish(w: Column) -> Column:
    """E31 in integer form: vowels/len < 0.2 ⇔ 5·vowels < len; distinct < len/3 ⇔ 3·distinct < len."""
    n = F.length(w)
    vowels = n - F.length(F.translate(w, "aeiou", ""))
    distinct = F.size(F.array_distinct(F.split(w, "")))
    return (n < 3) | ((5 * vowels < n) & (n > 4)) | (3 * distinct < n)


def keep_keyword(w: Column, min_length: int = KEYWORD_MIN_LENGTH, stop_words=None) -> Column:
    """Long enough, not a stop word, ASCII, not all digits, not gibberish."""
    stops = list(STOP_WORDS if stop_words is None else stop_words)
    return (
        (F.length(w) >= min_length)
        & ~w.isin(stops)
        & w.rlike(r"^[\x00-\x7F]+$")
        & ~w.rlike(r"^[0-9]+$")
        & ~is_gibberish(w)
    )


def page_tokens(pages: DataFrame, min_length: int = KEYWORD_MIN_LENGTH, stop_words=None) -> DataFrame:
    """One row per kept token: (page_id, url, site, pos, keyword)."""
    return (
        pages.select("page_id", "url", "site", F.posexplode(tokens(F.col("html"))).alias("pos", "keyword"))
        .where(keep_keyword(F.col("keyword"), min_length, stop_words))
    )


def page_keywords(pages: DataFrame, **kw) -> DataFrame:
    """A1: per-page keyword frequency with the word's first position."""
    return page_tokens(pages, **kw).groupBy("page_id", "url", "site", "keyword").agg(
        F.count(F.lit(1)).alias("frequency"), F.min("pos").alias("first_pos")
    )


def page_top_keywords(pages: DataFrame, k: int = KEYWORDS_PER_PAGE, **kw) -> DataFrame:
    """``most_common(k)`` per page; ties by first appearance. ``rank`` is 1-based."""
    w = Window.partitionBy("page_id").orderBy(F.col("frequency").desc(), F.col("first_pos"))
    return (
        page_keywords(pages, **kw)
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
    )


def site_keywords(pages: DataFrame, **kw) -> DataFrame:
    """A2: per-site frequency over **all** kept tokens (not the per-page top-k)."""
    return page_tokens(pages, **kw).groupBy("site", "keyword").agg(F.count(F.lit(1)).alias("frequency"))


def top_k(df: DataFrame, k: int, by: str = "site", order=("frequency", "keyword")) -> DataFrame:
    """Per-group top-k, count descending, ties alphabetical."""
    w = Window.partitionBy(by).orderBy(F.col(order[0]).desc(), F.col(order[1]))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def site_top_keywords(pages: DataFrame, k: int = 100, **kw) -> DataFrame:
    return top_k(site_keywords(pages, **kw), k)
