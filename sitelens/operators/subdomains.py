"""Subdomain enumeration (J4, J5, S9, S14) and crawl seeds.

Candidates are ``label.domain`` for every label of the fixed word list, made
with a generator (``explode`` of a literal array: 122 rows per domain, no join),
then equi-joined with an address table ``dns(name, ip, pos)``; the first A
record (lowest ``pos``) wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.functions.lookups import SUBDOMAIN_LABELS


def candidates(domains: DataFrame, labels=None) -> DataFrame:
    words = F.array(*[F.lit(w) for w in (labels or SUBDOMAIN_LABELS)])
    return domains.select("site", F.explode(words).alias("label")).select(
        "site", F.concat(F.col("label"), F.lit("."), F.col("site")).alias("subdomain")
    )


def resolve(domains: DataFrame, dns: DataFrame, labels=None) -> DataFrame:
    """J5 + S14: (site, subdomain, ip) for candidates that have an A record."""
    first = dns.groupBy("name").agg(F.min_by("ip", "pos").alias("ip"))
    return candidates(domains, labels).join(first, F.col("subdomain") == F.col("name")).select("site", "subdomain", "ip")


def insert_if_absent(existing: DataFrame, new: DataFrame, key: str = "subdomain", order: str = "ip") -> DataFrame:
    """Keyed insert, first write wins: rows whose key already exists are ignored, and of several
    new rows of a key the first by ``order`` stays."""
    rest = [c for c in new.columns if c != key]
    first = new.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r")).select(key, "_r.*")
    fresh = first.join(existing.select(key), key, "left_anti").select(*new.columns)
    return existing.unionByName(fresh, allowMissingColumns=True)


def seeds(domains: DataFrame, found: DataFrame) -> DataFrame:
    """``https://domain`` plus ``https://sub`` for every found subdomain, depth 0."""
    base = domains.select("site", F.concat(F.lit("https://"), F.col("site")).alias("url"))
    subs = found.select("site", F.concat(F.lit("https://"), F.col("subdomain")).alias("url"))
    return base.unionByName(subs).distinct().withColumn("depth", F.lit(0))
