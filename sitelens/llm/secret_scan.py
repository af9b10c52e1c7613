"""Secret scan with corpus-wide ownership frequency (operator 2).

Every text is scanned for credential-shaped spans. Each candidate value is hashed, and the
hashes are aggregated over the whole corpus by distinct owners and distinct repositories. A value
held by many owners is a widely copied example (documentation keys, test fixtures); a value
that stays with few owners and looks random is live.

Kinds, in the order used for ties:

* ``assign``  a named value (``token = "..."``), ``access`` an access key id, ``hex`` a long hex run:
  always reported, whatever the frequency says;
* ``mixed``   a long token of upper case, lower case and digits with high entropy: a candidate
  that is reported only when the ownership counts say it is owner-specific.

Cases: a null text has no spans; a null owner or repository counts as one unnamed owner or
repository; repeated rows are scanned and returned row by row, and add nothing to distinct
counts; an empty table gives an empty result; other columns are ignored or kept untouched.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.llm.common import store

KINDS = ("assign", "access", "hex", "mixed")
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIXED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_-])")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

SPANS = T.ArrayType(
    T.StructType()
    .add("kind", T.StringType())
    .add("start", T.IntegerType())
    .add("end", T.IntegerType())
    .add("digest", T.StringType())
)


def entropy(value: str) -> float:
    """Shannon entropy in bits per character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def looks_random(value: str) -> bool:
    """Upper case, lower case and digits all present, and at least 3.5 bits per character."""
    return (
        any(c.isdigit() for c in value)
        and any(c.islower() for c in value)
        and any(c.isupper() for c in value)
        and entropy(value) >= 3.5
    )


def find_spans(text: str | None) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) by start, then kind; positions are code points, end exclusive.
    ``value`` is the credential itself: what is assigned, or the whole match."""
    if not text:
        return []
    found = []
    low = text.lower()
    if any(name in low for name in NAMES):
        found += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    found += [("mixed", m.start(), m.end(), m[0]) for m in MIXED.finditer(text) if looks_random(m[0])]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


@F.pandas_udf(SPANS)
def _spans(texts: pd.Series) -> pd.Series:
    return pd.Series(
        [
            [
                {"kind": k, "start": a, "end": b, "digest": hashlib.sha256(v.encode()).hexdigest()}
                for k, a, b, v in find_spans(text)
            ]
            for text in texts
        ],
        dtype=object,
    )


def candidate_spans(text: Column) -> Column:
    """array<struct<kind,start,end,digest>> of the candidates in a text."""
    return _spans(F.coalesce(text.cast("string"), F.lit("")))


def ownership(found: DataFrame, spans: str, owner: str, repo: str) -> DataFrame:
    """digest -> n_owners, n_repos. A digest held by a third of all rows is reduced to its
    distinct (owner, repo) pairs before the shuffle, and the counts over those pairs are again
    partial sums, so no task gathers the rows of one digest."""
    pairs = found.select(
        F.explode(F.array_distinct(F.transform(spans, lambda s: s["digest"]))).alias("digest"),
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
        F.coalesce(F.col(repo).cast("string"), F.lit("")).alias("repo"),
    ).distinct()
    owners = pairs.select("digest", "owner").distinct().groupBy("digest").agg(F.count("*").alias("n_owners"))
    repos = pairs.select("digest", "repo").distinct().groupBy("digest").agg(F.count("*").alias("n_repos"))
    return owners.join(repos, "digest")


def scan(
    docs: DataFrame, text: str, owner: str, repo: str, example_owners: int = 4, keep_text: bool = True
) -> DataFrame:
    """``docs`` with one more column ``spans`` (a column of that name is replaced):
    array<struct<start,kind,end,example>> in order.

    ``example`` is true for a value held by at least ``example_owners`` distinct owners and by more
    than one repository. A ``mixed`` candidate is kept only when it is not such an example.
    Texts are scanned once; the rows with their candidates are written to the shared folder
    (without the text unless ``keep_text``), and only candidates are shuffled."""
    found = docs.withColumn("spans", candidate_spans(F.col(text)))
    if not keep_text:
        found = found.drop(text)
    found = store(found.withColumn("_scan_row", F.monotonically_increasing_id()), "secrets")
    freq = ownership(found, "spans", owner, repo)
    judged = (
        found.select("_scan_row", F.explode("spans").alias("s"))
        .join(freq, F.col("s.digest") == freq["digest"])
        .withColumn("example", (F.col("n_owners") >= example_owners) & (F.col("n_repos") > 1))
        .filter((F.col("s.kind") != "mixed") | ~F.col("example"))
        .groupBy(F.col("_scan_row").alias("_judged_row"))
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        F.col("s.start").alias("start"),
                        F.array_position(F.array(*map(F.lit, KINDS)), F.col("s.kind")).alias("rank"),
                        F.col("s.kind").alias("kind"),
                        F.col("s.end").alias("end"),
                        "example",
                    )
                )
            ).alias("_judged")
        )
    )
    some, none = found.filter(F.size("spans") > 0), found.filter(F.size("spans") == 0)
    judged_spans = F.transform(
        F.coalesce("_judged", F.array()).cast("array<struct<start:int,rank:bigint,kind:string,end:int,example:boolean>>"),
        lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["example"].alias("example")),
    )
    some = some.join(judged, F.col("_scan_row") == F.col("_judged_row"), "left").withColumn("spans", judged_spans)
    none = none.withColumn("spans", F.array().cast("array<struct<start:int,kind:string,end:int,example:boolean>>"))
    return none.drop("_scan_row").unionByName(some.drop("_scan_row", "_judged_row", "_judged"))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined in order."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


@F.pandas_udf(T.StringType())
def _masked(texts: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for text, found in zip(texts, spans):
        if text is None or len(found) == 0:
            out.append(text)
            continue
        parts, at = [], 0
        for s in found:
            start, end = max(s["start"], at), s["end"]
            if end <= at:
                continue
            parts += [text[at:start], "[EXAMPLE_KEY]" if s["example"] else "[SECRET]"]
            at = end
        out.append("".join(parts) + text[at:])
    return pd.Series(out, dtype=object)


def redact(scanned: DataFrame, text: str) -> DataFrame:
    """Replace each span by a placeholder that tells live values from widely copied examples
    (overlapping spans are replaced together)."""
    return scanned.withColumn(
        text, F.when(F.size("spans") > 0, _masked(F.col(text), F.col("spans"))).otherwise(F.col(text))
    )
