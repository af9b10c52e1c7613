"""Bounded breadth-first traversal of the link graph.

One Spark job per level (at most ``max_depth`` + 1 levels):

    frontier ⋈ edges (on src)  →  distinct targets  →  anti-join the visited levels

The distinct edges are written once, as a table bucketed and sorted by source below the shared checkpoint folder: a level
joins it in place, and only the frontier is shuffled (or broadcast while it is small). Each level is a folder of
one visited table, so plans stay flat and a lost executor costs a re-read. A bucket holds whole pages, whose links their
size bounds; equal targets are reduced before they are shuffled. The driver only sees per-level row counts; no URL is collected.

Several domains are searched in one pass: seeds with a ``domain`` carry it along, each domain has its own visited set, and
its links are kept by its own scope.

Depth is the exact BFS minimum (the threaded original only approximates it).
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.session import ensure_checkpoint_dir, written


@dataclass
class Traversal:
    """The visited set, one table that grows by a folder a level, and the frontier's size at each level."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...] = ("url",)
    sizes: list[int] = field(default_factory=list)

    @property
    def visited(self) -> DataFrame:
        """(url, depth) of all levels, with the domain where there are several."""
        return self.spark.read.schema(f"{self._columns()}, depth int").parquet(self.path)

    def _columns(self) -> str:
        return ", ".join(f"{k} string" for k in self.keys)

    @property
    def peak_frontier(self) -> int:
        return max(self.sizes) if self.sizes else 0

    def add(self, urls: DataFrame) -> DataFrame:
        """Write the keys in ``urls`` as the next level and return it, read back."""
        level = os.path.join(self.path, f"depth={len(self.sizes)}")
        urls.select(*self.keys).write.parquet(level)
        frontier = self.spark.read.schema(self._columns()).parquet(level)
        self.sizes.append(frontier.count())
        return frontier


def prepare_edges(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) as a table bucketed and sorted by src. One shuffle, by src, serves the distinct rows, the
    buckets and all levels; with as many buckets as shuffle partitions a join leaves it where it is."""
    spark = edges.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"sitelens_edges_{uuid.uuid4().hex}"
    path = os.path.join(ensure_checkpoint_dir(spark), name)
    links = edges.select("src", "dst").where(F.col("dst").isNotNull()).repartition(buckets, "src").distinct()
    links.write.bucketBy(buckets, "src").sortBy("src").option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


def traverse(edges: DataFrame, seeds: DataFrame, max_depth: int = 3, expandable: DataFrame | None = None,
             prepared: bool = False, in_scope: Callable[[Column, Column], Column] | None = None) -> Traversal:
    """BFS from ``seeds(url)`` over ``edges(src, dst)`` up to ``max_depth`` (inclusive).

    ``expandable(url)``, when given, limits which visited URLs emit links
    (fetched, HTML, allowed by robots, not a challenge page); the others are
    visited but are leaves, as in the original crawler. It is evaluated once.

    Seeds (domain, url) start one search a domain: a page that several domains reach is visited by each at its own depth.
    ``in_scope`` (target, domain) says which links a domain follows.
    """
    e = edges if prepared else prepare_edges(edges)
    spark = e.sparkSession
    if expandable is not None:
        expandable = written(expandable.select("url").distinct(), "expandable")
    keys = ("domain", "url") if "domain" in seeds.columns else ("url",)
    t = Traversal(spark, os.path.join(ensure_checkpoint_dir(spark), f"sitelens-visited-{uuid.uuid4().hex}"), keys)
    frontier = t.add(seeds.select(*keys).distinct())
    for _ in range(max_depth):
        if expandable is not None:  # the frontier is asked, not all edges
            frontier = frontier.join(expandable, "url", "left_semi").select(*keys)
        frontier = t.add(next_level(frontier, e, in_scope).join(t.visited.select(*keys), list(keys), "left_anti"))  # J1
        if t.sizes[-1] == 0:
            t.sizes.pop()
            break
    return t


def next_level(frontier: DataFrame, edges: DataFrame, in_scope: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Distinct targets of the frontier's links (for each domain, those in its scope)."""
    reached = frontier.join(edges, frontier["url"] == edges["src"])
    if "domain" not in frontier.columns:
        return reached.select(F.col("dst").alias("url")).distinct()
    if in_scope is not None:
        reached = reached.where(in_scope(F.col("dst"), F.col("domain")))
    return reached.select("domain", F.col("dst").alias("url")).distinct()


def new_per_page(edges: DataFrame, t: Traversal, max_depth: int) -> DataFrame:
    """Per expanded page, targets that were new when it was crawled
    (their BFS depth is one more than the page's)."""
    v = t.visited
    src = v.where(F.col("depth") < max_depth).select(F.col("url").alias("src"), F.col("depth").alias("src_depth"))
    dst = v.select(F.col("url").alias("dst"), F.col("depth").alias("dst_depth"))
    e = edges.select("src", "dst").join(src, "src").distinct()  # links of pages that were not expanded go first
    j = e.join(dst, "dst").where(F.col("dst_depth") == F.col("src_depth") + 1)
    return j.groupBy("src").agg(F.count(F.lit(1)).alias("new_urls"))


def fetch_visited(t: Traversal, pages: DataFrame) -> DataFrame:
    """Visited URLs joined to the page store (the crawl's result rows)."""
    return t.visited.join(pages.drop("depth"), "url")


def crawl(pages: DataFrame, seeds: DataFrame, max_depth: int = 3, robots: DataFrame | None = None,
          agent: str | None = None, respect_robots: bool = True) -> tuple[DataFrame, Traversal]:
    """Crawl a page store from ``seeds(url)``.

    Only stored pages of the seeds' sites take part: a link in scope of a site
    leads to a page of that site. Links come from their in-scope endpoints (E25); pages that are
    HTML, not challenge pages and allowed by robots expand. Returns the result rows
    (J2: visited ⋈ page store) and the traversal.
    """
    from sitelens.functions.lookups import USER_AGENTS
    from sitelens.functions.urls import site_of
    from sitelens.operators import challenge as C
    from sitelens.operators import extract as X
    from sitelens.operators import robots as RB

    sites = seeds.select(site_of(F.col("url")).alias("site")).distinct()
    pages = pages.withColumn("status_code", F.coalesce("status_code", F.lit(200))).join(sites, "site", "left_semi")
    html = F.coalesce(F.col("content_type").contains("text/html"), F.lit(True))
    ok = pages.where(html & ~C.is_challenge(F.col("status_code"), F.col("html")))
    ok = RB.can_fetch(ok, robots, agent or USER_AGENTS["pc"], respect_robots).where("allowed").drop("allowed")
    edges = X.endpoints(ok).where("in_scope").select(F.col("url").alias("src"), F.col("endpoint").alias("dst"))
    t = traverse(edges, seeds, max_depth)
    return fetch_visited(t, C.drop_challenges(pages)), t


def crawl_domains(pages: DataFrame, domains: DataFrame, dns: DataFrame, max_depth: int = 3, robots: DataFrame | None = None,
                  agent: str | None = None, respect_robots: bool = True) -> tuple[DataFrame, DataFrame, Traversal]:
    """The whole crawl of ``domains(site)``: enumerate subdomains (J4, J5), seed (U1), traverse, and
    roll the result pages up into statistics (A20). Returns (results, statistics, traversal)."""
    from sitelens.functions.urls import site_of
    from sitelens.operators import stats as ST
    from sitelens.operators import subdomains as SD

    found = written(SD.resolve(domains, dns), "subdomains")
    results, t = crawl(pages, SD.seeds(domains, found).select("url"), max_depth, robots, agent, respect_robots)
    peaks = t.visited.groupBy(site_of(F.col("url")).alias("site"), "depth").agg(F.count("*").alias("n"))
    peaks = peaks.groupBy("site").agg(F.max("n").alias("peak_queue_size"))
    return results, ST.site_statistics(results.drop("depth"), subdomains=found, peak_queue=peaks), t
