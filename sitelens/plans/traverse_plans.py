"""Traversal, robots and subdomain queries over a link graph composed from the
TPC-H style tables: region → nation → customer/supplier → order/part, with
back edges (nation → region, order → customer, part → supplier) for cycles."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelens.functions.lookups import SUBDOMAIN_LABELS, USER_AGENTS
from sitelens.functions.urls import host
from sitelens.operators import robots as RB
from sitelens.operators import subdomains as SD
from sitelens.operators import traverse as TR
from sitelens.plans import sqlparts as S
from sitelens.plans.registry import register
from sitelens.sources.pages import load_pages, read_table

G = "https://graph.example.com"
GRAPH_SITE = "graph.example.com"
MAX_DEPTH = 3


def node(kind: str, key) -> F.Column:
    return F.concat(F.lit(f"{G}/{kind}/"), key.cast("string"), F.lit("/"))


def graph_edges(spark, sf_dir):
    t = lambda n: read_table(spark, sf_dir, n)
    nation, customer, supplier, orders, lineitem = t("nation"), t("customer"), t("supplier"), t("orders"), t("lineitem")
    e = lambda df, s, d: df.select(s.alias("src"), d.alias("dst"))
    li = lineitem.select("l_suppkey", "l_partkey")
    return (
        e(nation, node("region", F.col("n_regionkey")), node("nation", F.col("n_nationkey")))
        .unionByName(e(nation, node("nation", F.col("n_nationkey")), node("region", F.col("n_regionkey"))))
        .unionByName(e(customer, node("nation", F.col("c_nationkey")), node("customer", F.col("c_custkey"))))
        .unionByName(e(supplier, node("nation", F.col("s_nationkey")), node("supplier", F.col("s_suppkey"))))
        .unionByName(e(orders, node("customer", F.col("o_custkey")), node("order", F.col("o_orderkey"))))
        .unionByName(e(orders, node("order", F.col("o_orderkey")), node("customer", F.col("o_custkey"))))
        .unionByName(e(li, node("supplier", F.col("l_suppkey")), node("part", F.col("l_partkey"))))
        .unionByName(e(li, node("part", F.col("l_partkey")), node("supplier", F.col("l_suppkey"))))
    )


def graph_seeds(spark, sf_dir):
    return read_table(spark, sf_dir, "region").select(node("region", F.col("r_regionkey")).alias("url"))


def _n(kind: str, key: str) -> str:
    return f"'{G}/{kind}/' || {key} || '/'"


EDGES_SQL = f"""e AS (
  SELECT {_n('region', 'n_regionkey')} AS src, {_n('nation', 'n_nationkey')} AS dst FROM nation
  UNION SELECT {_n('nation', 'n_nationkey')}, {_n('region', 'n_regionkey')} FROM nation
  UNION SELECT {_n('nation', 'c_nationkey')}, {_n('customer', 'c_custkey')} FROM customer
  UNION SELECT {_n('nation', 's_nationkey')}, {_n('supplier', 's_suppkey')} FROM supplier
  UNION SELECT {_n('customer', 'o_custkey')}, {_n('order', 'o_orderkey')} FROM orders
  UNION SELECT {_n('order', 'o_orderkey')}, {_n('customer', 'o_custkey')} FROM orders
  UNION SELECT {_n('supplier', 'l_suppkey')}, {_n('part', 'l_partkey')} FROM lineitem
  UNION SELECT {_n('part', 'l_partkey')}, {_n('supplier', 'l_suppkey')} FROM lineitem)"""


def _bfs_sql(expand_filter: str = "") -> str:
    return f"""WITH RECURSIVE {EDGES_SQL},
r(url, depth) AS (
  SELECT {_n('region', 'r_regionkey')}, 0 FROM region
  UNION
  SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.url WHERE r.depth < {MAX_DEPTH} {expand_filter}
),
v AS (SELECT url, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY url)"""


BFS_SQL = _bfs_sql() + " SELECT url, depth FROM v"


@register("bfs_depth", BFS_SQL)
def bfs_depth(spark, sf_dir):
    """Visited URLs with exact BFS depth ≤ 3 (the default max depth)."""
    t = TR.traverse(graph_edges(spark, sf_dir), graph_seeds(spark, sf_dir), MAX_DEPTH)
    return t.visited.select("url", F.col("depth").cast("int").alias("depth"))


@register("bfs_frontier_peak", _bfs_sql() + " SELECT depth, count(*) AS frontier FROM v GROUP BY depth")
def bfs_frontier_peak(spark, sf_dir):
    """Frontier size per level (peak = max); counts come from the traversal itself."""
    t = TR.traverse(graph_edges(spark, sf_dir), graph_seeds(spark, sf_dir), MAX_DEPTH)
    return t.visited.groupBy(F.col("depth").cast("int").alias("depth")).agg(F.count(F.lit(1)).alias("frontier"))


NEW_SQL = _bfs_sql() + f"""
SELECT e.src, count(*) AS new_urls FROM (SELECT DISTINCT src, dst FROM e) e
JOIN v s ON s.url = e.src JOIN v d ON d.url = e.dst
WHERE s.depth < {MAX_DEPTH} AND d.depth = s.depth + 1 GROUP BY e.src
"""


@register("bfs_new_per_page", NEW_SQL)
def bfs_new_per_page(spark, sf_dir):
    """New URLs discovered per crawled page."""
    edges = TR.prepare_edges(graph_edges(spark, sf_dir))
    t = TR.traverse(edges, graph_seeds(spark, sf_dir), MAX_DEPTH, prepared=True)
    return TR.new_per_page(edges, t, MAX_DEPTH)


# ---- robots (S13, F2, F17, J3) ----------------------------------------------------
def graph_robots(spark, sf_dir):
    """One robots.txt for the graph site; the wildcard group lists region-2 nations."""
    nation = read_table(spark, sf_dir, "nation")
    blocked = nation.where(F.col("n_regionkey") == 2).select(
        F.col("n_nationkey").alias("k"), F.concat(F.lit("Disallow: /nation/"), F.col("n_nationkey").cast("string"), F.lit("/")).alias("line")
    )
    head = (
        "# robots for the graph site\n"
        "User-agent: othercrawler\nDisallow: /\n\n"
        f"User-agent: {USER_AGENTS['pc'].split('/')[0]}\nAllow: /nation/3/\nDisallow: /nation/\nDisallow: /order/\n\n"
        "User-agent: *\nDisallow: /customer/\n"
    )
    lines = blocked.agg(F.sort_array(F.collect_list(F.struct("k", "line"))).alias("l"))
    body = F.concat(F.lit(head), F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n"))
    return lines.select(F.lit(GRAPH_SITE).alias("site"), body.alias("body"))


def graph_nodes(edges):
    # each end is made distinct by itself: the sources of prepared edges stay in their buckets
    ends = edges.select(F.col("src").alias("url")).distinct().unionByName(edges.select(F.col("dst").alias("url")).distinct())
    return ends.distinct().withColumn("site", F.lit(GRAPH_SITE))


ALLOWED_PC = "NOT (starts_with(regexp_extract(url, '^https://[^/]*(.*)$', 1), '/nation/') AND NOT starts_with(regexp_extract(url, '^https://[^/]*(.*)$', 1), '/nation/3/')) AND NOT starts_with(regexp_extract(url, '^https://[^/]*(.*)$', 1), '/order/')"
ALLOWED_MOBILE = (
    "NOT starts_with(regexp_extract(url, '^https://[^/]*(.*)$', 1), '/customer/') AND "
    f"NOT list_contains((SELECT list({_n('nation', 'n_nationkey')}) FROM nation WHERE n_regionkey = 2), url)"
)
NODES_SQL = f"{EDGES_SQL}, nodes AS (SELECT dst AS url FROM e UNION SELECT src FROM e)"

ROBOTS_SQL = f"WITH {NODES_SQL} SELECT url, {ALLOWED_PC} AS allowed_pc, {ALLOWED_MOBILE} AS allowed_mobile FROM nodes"


@register("robots_filter", ROBOTS_SQL)
def robots_filter(spark, sf_dir):
    """Robots decision per URL for the desktop and mobile agents."""
    robots = graph_robots(spark, sf_dir)
    nodes = graph_nodes(graph_edges(spark, sf_dir))
    both = RB.can_fetch_as(nodes, robots, {"allowed_pc": USER_AGENTS["pc"], "allowed_mobile": USER_AGENTS["mobile"]})
    return both.select("url", "allowed_pc", "allowed_mobile")


BFS_ROBOTS_SQL = (
    _bfs_sql(f"AND {ALLOWED_PC.replace('url', 'r.url')}")
    + " SELECT url, depth FROM v"
)


@register("bfs_with_robots", BFS_ROBOTS_SQL)
def bfs_with_robots(spark, sf_dir):
    """G1 + F2: blocked URLs are visited but never expanded."""
    robots = graph_robots(spark, sf_dir)
    edges = TR.prepare_edges(graph_edges(spark, sf_dir))
    allowed = RB.can_fetch(graph_nodes(edges), robots, USER_AGENTS["pc"]).where("allowed").select("url")
    t = TR.traverse(edges, graph_seeds(spark, sf_dir), MAX_DEPTH, expandable=allowed, prepared=True)
    return t.visited.select("url", F.col("depth").cast("int").alias("depth"))


# ---- subdomains (J4, J5, S9, S14) and seeds (U1) ------------------------------------
def page_dns(spark, sf_dir):
    """Address records for every host of the page store: two records per host,
    the first (pos 0) is the one the enumeration keeps."""
    p = read_table(spark, sf_dir, "pages").select(host(F.col("url")).alias("name")).distinct()
    ip0 = F.concat(F.lit("10.0."), F.length("name").cast("string"), F.lit("."), F.ascii("name").cast("string"))
    ip1 = F.concat(F.lit("10.1."), F.length("name").cast("string"), F.lit(".1"))
    return p.select("name", ip0.alias("ip"), F.lit(0).alias("pos")).unionByName(p.select("name", ip1.alias("ip"), F.lit(1).alias("pos")))


LABELS_SQL = "[" + ", ".join(f"'{w}'" for w in SUBDOMAIN_LABELS) + "]"
DNS_SQL = f"""dns AS (SELECT DISTINCT {S.host('url')} AS name FROM pages),
first_a AS (SELECT name, '10.0.' || length(name) || '.' || ascii(name) AS ip FROM dns),
sites AS (SELECT DISTINCT {S.site('url')} AS site FROM pages),
cand AS (SELECT site, unnest({LABELS_SQL}) || '.' || site AS subdomain FROM sites)"""

SUBS_SQL = f"WITH {DNS_SQL} SELECT site, subdomain, ip FROM cand JOIN first_a ON name = subdomain"


@register("subdomains_resolved", SUBS_SQL)
def subdomains_resolved(spark, sf_dir):
    """J4 + J5 + S14: word-list candidates of every site that resolve, first A record."""
    sites = load_pages(spark, sf_dir).select("site").distinct()
    found = SD.resolve(sites, page_dns(spark, sf_dir))
    # Insert-if-absent into an (initially empty) subdomain table.
    empty = found.limit(0)
    return SD.insert_if_absent(empty, found).select("site", "subdomain", "ip")


SEEDS_SQL = f"""WITH {DNS_SQL}
SELECT site, 'https://' || site AS url FROM sites
UNION SELECT site, 'https://' || subdomain FROM cand JOIN first_a ON name = subdomain
"""


@register("seed_urls", SEEDS_SQL)
def seed_urls(spark, sf_dir):
    """Crawl seeds = the site root plus every found subdomain root."""
    sites = load_pages(spark, sf_dir).select("site").distinct()
    found = SD.resolve(sites, page_dns(spark, sf_dir))
    return SD.seeds(sites, found).select("site", "url")
