"""Redirect chains (F9, D1), merges of overlapping runs (U3, U9, A3, T2) and searches of several domains."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelens.functions.urls import in_scope
from sitelens.operators import keywords as K
from sitelens.operators import merge as M
from sitelens.operators import redirects as RD
from sitelens.operators import stats as ST
from sitelens.operators import traverse as TR
from sitelens.plans import sqlparts as S
from sitelens.plans.compose import FILE_SAMPLES, SHOP, part_pages
from sitelens.plans.registry import register
from sitelens.session import written
from sitelens.sources.pages import load_pages, read_table

# ---- F9, D1 ---------------------------------------------------------------------------
# Customer k redirects to k // 3, but every tenth one ends a chain, and those that end in 8 and 9 send to each other.
REDIRECT_CTE = """nxt AS (
  SELECT 'https://accounts.example.com/c/' || c_custkey AS src,
         'https://accounts.example.com/c/' || CASE c_custkey % 10 WHEN 8 THEN c_custkey + 1 WHEN 9 THEN c_custkey - 1 ELSE c_custkey // 3 END AS dst
  FROM customer WHERE c_custkey % 10 <> 0)"""
REDIRECT_SQL = f"""
WITH RECURSIVE {REDIRECT_CTE},
walk(url, at_, hops) AS (
  SELECT src, dst, 1 FROM nxt
  UNION ALL SELECT url, dst, hops + 1 FROM walk JOIN nxt ON src = at_ WHERE hops < 60),
last AS (SELECT url, at_, hops, at_ IN (SELECT src FROM nxt) AS loop FROM walk QUALIFY row_number() OVER (PARTITION BY url ORDER BY hops DESC) = 1)
SELECT url, CASE WHEN NOT loop THEN at_ END AS final, CASE WHEN NOT loop THEN hops END::BIGINT AS hops, loop,
       CASE WHEN NOT loop THEN CASE c_mktsegment WHEN 'BUILDING' THEN 403 WHEN 'AUTOMOBILE' THEN 503 WHEN 'FURNITURE' THEN 404 ELSE 200 END END AS final_status
FROM last LEFT JOIN customer ON at_ = 'https://accounts.example.com/c/' || c_custkey
"""


@register("redirect_targets", REDIRECT_SQL)
def redirect_targets(spark, sf_dir):
    """Where every chain of redirects ends, after how many hops, with what status; loops are marked."""
    c = read_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    url = lambda key: F.concat(F.lit("https://accounts.example.com/c/"), key.cast("string"))
    to = F.when(k % 10 == 8, k + 1).when(k % 10 == 9, k - 1).otherwise(F.floor(k / 3))
    hops = c.where(k % 10 != 0).select(url(k).alias("src"), url(to).alias("dst"))
    status = F.when(F.col("c_mktsegment") == "BUILDING", 403).when(F.col("c_mktsegment") == "AUTOMOBILE", 503)
    status = status.when(F.col("c_mktsegment") == "FURNITURE", 404).otherwise(200)
    latest = c.select(url(k).alias("url"), status.alias("status_code"), F.lit(None).cast("string").alias("error_type"))
    found = RD.targets_with_status(RD.final_targets(hops), latest)
    return found.select("url", "final", "hops", "loop", "final_status")


# ---- U9, A3 on overlapping runs ---------------------------------------------------------
# The old run has the parts with id % 3 <> 1, the new one those with id % 3 <> 2: together all, a third twice. Pages of the new
# run name another address, and lose the second form.
def _old_run(spark, sf_dir):
    p = part_pages(spark, sf_dir).where(F.col("page_id") % 3 != 1)
    return p.withColumn("html", F.concat("html", F.lit("<p>s"), (F.col("page_id") % 40).cast("string"), F.lit("@shop.example.com</p>")))


def _new_run(spark, sf_dir):
    p = part_pages(spark, sf_dir).where(F.col("page_id") % 3 != 2)
    mail = F.concat(F.lit("<p>s"), (F.col("page_id") % 60).cast("string"), F.lit("@shop.example.com</p>"))
    return p.withColumn("html", F.concat(F.replace("html", F.lit('<form action="/search">'), F.lit("<div>")), mail))


_FILES = ", ".join(str(i) for i, (_, t) in enumerate(FILE_SAMPLES) if t)
BOTH_SQL = f"""
WITH p AS (SELECT *, p_partkey % 3 <> 2 AS is_new FROM part),
stats AS (SELECT count(*) AS total_urls_visited, sum(1 + CASE WHEN p_partkey % 4 = 0 AND NOT is_new THEN 1 ELSE 0 END) AS forms_found,
    sum(1 + CASE WHEN p_partkey % 3 = 1 THEN 1 ELSE 0 END) AS images_found, count(*) FILTER (WHERE p_partkey % 5 < 4) AS videos_found,
    count(*) FILTER (WHERE p_partkey % {len(FILE_SAMPLES)} IN ({_FILES})) AS files_found, count(*) AS api_endpoints,
    count(DISTINCT CASE WHEN is_new THEN p_partkey % 60 ELSE p_partkey % 40 END) AS unique_emails FROM p),
long AS (SELECT 'shop.example.com' AS site, stat, n::BIGINT AS value FROM
  (UNPIVOT stats ON total_urls_visited, forms_found, images_found, videos_found, files_found, api_endpoints, unique_emails INTO NAME stat VALUE n))
"""
COUNTED = ["total_urls_visited", "forms_found", "images_found", "videos_found", "files_found", "api_endpoints", "unique_emails"]


@register("merge_facts_overlapping", BOTH_SQL + "SELECT site, stat, value FROM long")
def merge_facts_overlapping(spark, sf_dir):
    """Statistics of two overlapping runs equal those of one run over both; shared pages and values count once."""
    facts = [written(ST.page_fact_rows(run, keep=("url",)), "facts") for run in (_old_run(spark, sf_dir), _new_run(spark, sf_dir))]
    merged = M.merge_facts(*facts)
    return ST.count_facts(merged).where(F.col("stat").isin(COUNTED))


# A sketch holds what either run saw, so addresses and forms that the new run lost stay counted.
SKETCH_SQL = BOTH_SQL.replace("stats AS (", "was AS (SELECT DISTINCT p_partkey % 40 AS mail FROM part WHERE p_partkey % 3 <> 1 UNION SELECT DISTINCT p_partkey % 60 FROM part WHERE p_partkey % 3 <> 2),\nstats AS (").replace(
    "CASE WHEN p_partkey % 4 = 0 AND NOT is_new THEN 1 ELSE 0 END", "CASE WHEN p_partkey % 4 = 0 AND p_partkey % 3 <> 1 THEN 1 ELSE 0 END"
).replace("count(DISTINCT CASE WHEN is_new THEN p_partkey % 60 ELSE p_partkey % 40 END) AS unique_emails", "(SELECT count(*) FROM was) AS unique_emails")


@register("merge_sketches_overlapping", SKETCH_SQL + "SELECT site, stat, value AS exact, true AS within FROM long")
def merge_sketches_overlapping(spark, sf_dir):
    """The same from sketches of a fixed size; each lies within four standard errors of the exact number."""
    facts = [written(ST.page_fact_rows(run, keep=("url",)), "facts") for run in (_old_run(spark, sf_dir), _new_run(spark, sf_dir))]
    guess = ST.count_sketches(ST.merge_sketches(*[ST.sketch_facts(f, lg_k=12) for f in facts])).withColumnRenamed("value", "guess")
    # what the sketches stand for: distinct values, and ordinals of the items of each page, of both runs
    both = facts[0].unionByName(facts[1]).groupBy("site", "url", "kind", "value").agg(F.max("n").alias("n"))
    exact = ST.count_facts(both).where(F.col("stat").isin(COUNTED)).withColumnRenamed("value", "exact")
    error = 4 * 1.04 / 2**6
    return exact.join(guess, ["site", "stat"]).select("site", "stat", "exact", (F.abs(F.col("guess") - F.col("exact")) <= 1 + error * F.col("exact")).alias("within"))


# ---- U3, T2 across runs -------------------------------------------------------------------
SUMMARY_SQL = f"""
WITH {S.pages_cte()}, {S.kw_tokens_cte()}, n AS (SELECT site, keyword, count(*) AS frequency FROM kw GROUP BY ALL)
SELECT site, keyword, frequency, row_number() OVER (PARTITION BY site ORDER BY frequency DESC, keyword) AS rank, 0::BIGINT AS error
FROM n QUALIFY rank <= 100
"""


@register("merge_keyword_summaries", SUMMARY_SQL)
def merge_keyword_summaries(spark, sf_dir):
    """The top 100 of three runs' summaries equals the top 100 of all pages, though each run ranks differently;
    the error says what a run that left a keyword out may have held of it."""
    p = load_pages(spark, sf_dir)
    runs = [M.keyword_summary(K.site_keywords(p.where(F.pmod("page_id", F.lit(3)) == i)), size=4000) for i in range(3)]
    merged = M.merge_summaries(M.merge_summaries(runs[0], runs[1], size=4000), runs[2], size=4000)
    return M.top_of_summary(merged, 100).select("site", "keyword", "frequency", F.col("rank").cast("long").alias("rank"), "error")


# ---- G1, G2, F11: a search for each domain ---------------------------------------------------
# Nations, customers and suppliers live on hosts of their own; the nation host lies in the scope of both domains.
_N, _C, _SP = "'https://n.eu.example.com/' || {}", "'https://c.eu.example.com/' || {}", "'https://s.example.com/' || {}"
DOMAINS_SQL = f"""
WITH RECURSIVE e AS (
  SELECT {_N.format('n_nationkey')} AS src, {_N.format('(n_nationkey * 7 + 1) % 25')} AS dst FROM nation
  UNION SELECT {_N.format('c_nationkey')}, {_C.format('c_custkey')} FROM customer
  UNION SELECT {_N.format('s_nationkey')}, {_SP.format('s_suppkey')} FROM supplier
  UNION SELECT {_SP.format('s_suppkey')}, {_N.format('(s_nationkey + 5) % 25')} FROM supplier
  UNION SELECT {_C.format('c_custkey')}, {_SP.format('c_custkey % 50')} FROM customer),
seeds(domain, url) AS (VALUES ('eu.example.com', {_N.format(0)}), ('example.com', {_N.format(3)}), ('s.example.com', {_SP.format(1)})),
r(domain, url, depth) AS (
  SELECT domain, url, 0 FROM seeds
  UNION SELECT domain, dst, depth + 1 FROM r JOIN e ON src = url
  WHERE depth < 3 AND contains(split_part(dst, '/', 3), domain))
SELECT domain, url, min(depth)::INTEGER AS depth FROM r GROUP BY ALL
"""


def domain_edges(spark, sf_dir):
    nation, customer, supplier = (read_table(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    at = lambda host, key: F.concat(F.lit(f"https://{host}.example.com/"), key.cast("string"))
    e = lambda df, src, dst: df.select(src.alias("src"), dst.alias("dst"))
    n, c, s = F.col("n_nationkey"), F.col("c_custkey"), F.col("s_suppkey")
    return (
        e(nation, at("n.eu", n), at("n.eu", (n * 7 + 1) % 25))
        .unionByName(e(customer, at("n.eu", F.col("c_nationkey")), at("c.eu", c)))
        .unionByName(e(supplier, at("n.eu", F.col("s_nationkey")), at("s", s)))
        .unionByName(e(supplier, at("s", s), at("n.eu", (F.col("s_nationkey") + 5) % 25)))
        .unionByName(e(customer, at("c.eu", c), at("s", c % 50)))
    )


@register("bfs_domains", DOMAINS_SQL)
def bfs_domains(spark, sf_dir):
    """Three domains searched in one pass, each with its own visited set, depths and scope."""
    seeds = spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(d).alias("domain"), F.lit(u).alias("url"))
        for d, u in (("eu.example.com", "https://n.eu.example.com/0"), ("example.com", "https://n.eu.example.com/3"), ("s.example.com", "https://s.example.com/1"))
    ])).alias("s")).select("s.*")
    t = TR.traverse(domain_edges(spark, sf_dir), seeds, max_depth=3, in_scope=in_scope)
    return t.visited.select("domain", "url", F.col("depth").cast("int").alias("depth"))
