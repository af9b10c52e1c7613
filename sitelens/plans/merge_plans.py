"""Run-merge queries (U2–U9, S12): two runs made by splitting the driver data
(page parity, event date), the old run round-tripped through its JSON document."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelens.operators import extract as X
from sitelens.operators import fetch as FT
from sitelens.operators import keywords as K
from sitelens.operators import merge as M
from sitelens.plans import sqlparts as S
from sitelens.plans.compose import event_fetches, part_pages
from sitelens.plans.extract_plans import EP_SQL
from sitelens.plans.fetch_plans import FETCH_CTE
from sitelens.plans.registry import register
from sitelens.sinks import writers as W
from sitelens.sources.pages import load_pages

SPLIT_TS = "2024-01-16"


def _runs(spark, sf_dir):
    p = load_pages(spark, sf_dir)
    return p.where(F.col("page_id") % 2 == 0), p.where(F.col("page_id") % 2 == 1)


MERGE_KW_SQL = f"""
WITH {S.pages_cte()}, {S.kw_tokens_cte()},
old_all AS (SELECT site, keyword, count(*) AS frequency FROM kw WHERE page_id % 2 = 0 GROUP BY site, keyword),
old_top AS (SELECT * FROM old_all QUALIFY row_number() OVER (PARTITION BY site ORDER BY frequency DESC, keyword) <= 100),
new_all AS (SELECT site, keyword, count(*) AS frequency FROM kw WHERE page_id % 2 = 1 GROUP BY ALL),
s AS (SELECT site, keyword, sum(frequency) AS frequency FROM (SELECT * FROM old_top UNION ALL SELECT * FROM new_all) GROUP BY ALL)
SELECT site, keyword, CAST(frequency AS BIGINT) AS frequency,
       row_number() OVER (PARTITION BY site ORDER BY frequency DESC, keyword) AS rank FROM s QUALIFY rank <= 100
"""


@register("merge_keywords", MERGE_KW_SQL)
def merge_keywords(spark, sf_dir):
    """Old run's top-100 plus the new run's full counts, re-ranked to 100."""
    old, new = _runs(spark, sf_dir)
    old_top = K.site_top_keywords(old, 100)
    merged = M.add_keywords(old_top, K.site_keywords(new), 100)
    return merged.select("site", "keyword", F.col("frequency").cast("bigint").alias("frequency"), F.col("rank").cast("bigint").alias("rank"))


MERGE_SETS_SQL = f"""
WITH e AS ({EP_SQL.replace('SELECT page_id, endpoint,', 'SELECT page_id, site, endpoint,', 1)}),
old_e AS (SELECT DISTINCT site, endpoint AS value FROM e WHERE in_scope AND page_id % 2 = 0),
new_e AS (SELECT site, value FROM (SELECT DISTINCT site, endpoint AS value FROM e WHERE in_scope AND page_id % 2 = 1)
          QUALIFY row_number() OVER (PARTITION BY site ORDER BY value) <= 1000),
{S.pages_cte()}
SELECT DISTINCT site, 'endpoints' AS kind, value FROM (SELECT * FROM old_e UNION ALL SELECT * FROM new_e)
UNION
SELECT DISTINCT site, 'emails', unnest(regexp_extract_all(html, '{S.sq(__import__('sitelens.functions.lookups', fromlist=['x']).EMAIL_PATTERN)}', 0)) FROM pg
"""


@register("merge_sets", MERGE_SETS_SQL)
def merge_sets(spark, sf_dir):
    """U2 + S4/S12: the old run's sets are written as result documents, read
    back, and union-merged with the new run (new endpoints capped at 1000)."""
    old, new = _runs(spark, sf_dir)
    old_ep = X.endpoints(old).where("in_scope").select("site", F.col("endpoint").alias("value")).distinct()
    old_em = X.emails(old).select("site", F.col("email").alias("value")).distinct()
    # The old run's sets are written as per-item sections of its result document.
    path = W.scratch_path(spark, "merge-sets")
    doc = old_ep.select("site").distinct().select(F.col("site").alias("target_domain"), W.output_name(F.col("site")).alias("output_name"))
    W.write_document(doc, path, {"endpoints": old_ep, "emails": old_em})
    # Read the prior run back.
    item = "site string, value string, output_name string"
    prior_ep = W.read_document(spark, path, item, section="endpoints").select("site", "value")
    prior_em = W.read_document(spark, path, item, section="emails").select("site", "value")
    ep = M.union_sets(prior_ep, X.endpoints(new).where("in_scope").select("site", F.col("endpoint").alias("value")), "value", new_cap=1000)
    em = M.union_sets(prior_em, X.emails(new).select("site", F.col("email").alias("value")), "value")
    return ep.withColumn("kind", F.lit("endpoints")).unionByName(em.withColumn("kind", F.lit("emails"))).select("site", "kind", "value")


MERGE_URLS_SQL = f"""
WITH {FETCH_CTE},
h AS (SELECT * FROM f WHERE contains(content_type, 'text/html') AND error_type IS NULL),
old_l AS (SELECT url, event_id, status_code FROM h WHERE ts < TIMESTAMP '{SPLIT_TS}' QUALIFY row_number() OVER (PARTITION BY url ORDER BY ts DESC, event_id DESC) = 1),
new_l AS (SELECT url, event_id, status_code FROM h WHERE ts >= TIMESTAMP '{SPLIT_TS}' QUALIFY row_number() OVER (PARTITION BY url ORDER BY ts DESC, event_id DESC) = 1)
SELECT * FROM new_l UNION ALL SELECT * FROM old_l WHERE url NOT IN (SELECT url FROM new_l)
"""


@register("merge_urls", MERGE_URLS_SQL)
def merge_urls(spark, sf_dir):
    """U4 + S8: url details of two runs, keyed overwrite (the new run wins)."""
    f = event_fetches(spark, sf_dir)
    old = FT.latest_by_url(f.where(F.col("ts") < F.lit(SPLIT_TS).cast("timestamp_ntz"))).select("url", "event_id", "status_code")
    new = FT.latest_by_url(f.where(F.col("ts") >= F.lit(SPLIT_TS).cast("timestamp_ntz"))).select("url", "event_id", "status_code")
    return M.overwrite_by_key(old, new, ["url"])


def _file_case_sql() -> str:
    from sitelens.plans.compose import FILE_SAMPLES

    return "CASE p_partkey % 10 " + " ".join(f"WHEN {i} THEN {repr(t) if t else 'NULL'}" for i, (_, t) in enumerate(FILE_SAMPLES)) + " END"


MERGE_FF_SQL = f"""
WITH fl AS (SELECT p_partkey, {_file_case_sql()} AS file_type FROM part),
old_f AS (SELECT file_type FROM fl WHERE p_partkey % 3 <> 0 AND file_type IS NOT NULL),
new_f AS (SELECT file_type FROM fl WHERE p_partkey % 3 = 0 AND file_type IS NOT NULL),
files AS (SELECT * FROM new_f UNION ALL SELECT * FROM old_f WHERE file_type NOT IN (SELECT file_type FROM new_f)),
forms AS (SELECT count(*) + count(*) FILTER (WHERE p_partkey % 4 = 0) AS n FROM part)
SELECT 'files' AS kind, file_type AS item, count(*) AS n FROM files GROUP BY file_type
UNION ALL SELECT 'forms', 'all', n FROM forms
"""


@register("merge_forms_files", MERGE_FF_SQL)
def merge_forms_files(spark, sf_dir):
    """U6 + U7: forms appended; a file type present in the new run replaces the old list."""
    p = part_pages(spark, sf_dir)
    old, new = p.where(F.col("page_id") % 3 != 0), p.where(F.col("page_id") % 3 == 0)
    files = M.overwrite_by_key(X.files(old), X.files(new), ["site", "file_type"])
    forms = M.append_runs(X.forms(old), X.forms(new))
    a = files.groupBy(F.lit("files").alias("kind"), F.col("file_type").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    b = forms.groupBy(F.lit("forms").alias("kind"), F.lit("all").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(b)


STATS_CTE = f"""{FETCH_CTE},
ok AS (SELECT *, ts < TIMESTAMP '{SPLIT_TS}' AS is_old FROM f WHERE error_type IS NULL),
st AS (SELECT site, is_old, avg(response_time) AS average_response_time, min(response_time) AS min_response_time,
              max(response_time) AS max_response_time, avg(size) AS average_page_size, sum(size) AS total_data_downloaded
       FROM ok GROUP BY ALL),
lng AS (UNPIVOT st ON average_response_time, min_response_time, max_response_time, average_page_size, total_data_downloaded
        INTO NAME stat VALUE value)"""

MERGE_STATS_SQL = f"""
WITH {STATS_CTE}
SELECT site, stat, round(sum(value), 6) AS value FROM lng GROUP BY site, stat
"""


@register("merge_statistics", MERGE_STATS_SQL)
def merge_statistics(spark, sf_dir):
    """U9 (compat): every numeric statistic of the two runs is summed."""
    f = event_fetches(spark, sf_dir)
    cut = F.lit(SPLIT_TS).cast("timestamp_ntz")

    def long(run):
        t = FT.timing(run)
        cols = ["average_response_time", "min_response_time", "max_response_time", "average_page_size", "total_data_downloaded"]
        arr = F.array(*[F.struct(F.lit(c).alias("stat"), F.col(c).cast("double").alias("value")) for c in cols])
        return t.select("site", F.explode(arr).alias("p")).select("site", "p.stat", "p.value")

    m = M.merge_statistics(long(f.where(F.col("ts") < cut)), long(f.where(F.col("ts") >= cut)), mode="compat")
    return m.select("site", "stat", F.round("value", 6).alias("value"))


MERGE_CT_SQL = f"""
WITH {FETCH_CTE}
SELECT split_part(content_type, ';', 1) AS content_type, count(*) AS n FROM f WHERE error_type IS NULL GROUP BY 1
"""


@register("merge_content_types", MERGE_CT_SQL)
def merge_content_types(spark, sf_dir):
    """U8: content-type counts of two runs added key by key."""
    f = event_fetches(spark, sf_dir)
    cut = F.lit(SPLIT_TS).cast("timestamp_ntz")

    def hist(run):
        return FT.type_histogram(run).groupBy("content_type").agg(F.sum("n").alias("n"))

    return M.add_counts(hist(f.where(F.col("ts") < cut)), hist(f.where(F.col("ts") >= cut)), ["content_type"]).select(
        "content_type", F.col("n").cast("bigint").alias("n")
    )


# The rows of both runs at once: what one run over all of them measures.
MERGE_RECOMPUTE_SQL = f"""
WITH {FETCH_CTE}, ok AS (SELECT * FROM f WHERE error_type IS NULL),
st AS (SELECT site, avg(response_time) AS average_response_time, min(response_time) AS min_response_time,
              max(response_time) AS max_response_time, sum(size)::DOUBLE AS total_data_downloaded, count(*)::DOUBLE AS total_urls_visited
       FROM ok GROUP BY site)
SELECT site, stat, round(value, 6) AS value
FROM (UNPIVOT st ON average_response_time, min_response_time, max_response_time, total_data_downloaded, total_urls_visited INTO NAME stat VALUE value)
"""


@register("merge_statistics_recompute", MERGE_RECOMPUTE_SQL)
def merge_statistics_recompute(spark, sf_dir):
    """U9 (recompute): the merged statistics of two runs equal those of one run over all rows."""
    f = FT.ok_rows(event_fetches(spark, sf_dir))
    cut = F.lit(SPLIT_TS).cast("timestamp_ntz")

    def long(run):
        t = FT.timing(run).join(run.groupBy("site").agg(F.count("*").alias("total_urls_visited")), "site")
        cols = ["average_response_time", "min_response_time", "max_response_time", "total_data_downloaded", "total_urls_visited"]
        arr = F.array(*[F.struct(F.lit(c).alias("stat"), F.col(c).cast("double").alias("value")) for c in cols])
        return t.select("site", F.explode(arr).alias("p")).select("site", "p.stat", "p.value")

    m = M.merge_statistics(long(f.where(F.col("ts") < cut)), long(f.where(F.col("ts") >= cut)), mode="recompute")
    return m.select("site", "stat", F.round("value", 6).alias("value"))


MERGE_PAGES_SQL = """
SELECT 'https://www.shop.example.com/d/' || p_partkey AS url,
       CASE WHEN p_partkey % 3 <> 2 THEN 'New ' ELSE '' END || p_name || ' é&lt;→ A' AS title_text, 100 + p_partkey % 100 AS description_length
FROM part
"""


@register("merge_seo", MERGE_PAGES_SQL)
def merge_seo(spark, sf_dir):
    """U4: SEO facts of two runs by URL that share a third of the pages and cover all; those keep the new facts (other titles)."""
    from sitelens.operators import seo as SEO
    from sitelens.plans.detail_plans import detail_pages

    p = detail_pages(spark, sf_dir)
    old = SEO.seo(p.where(F.col("page_id") % 3 != 1))
    new = SEO.seo(p.where(F.col("page_id") % 3 != 2).withColumn("html", F.replace("html", F.lit("<title>"), F.lit("<title>New "))))
    facts = ["url", "title_text", "description_length"]
    return M.overwrite_by_key(old.select(*facts), new.select(*facts), ["url"])


MERGE_PHONES_SQL = """
SELECT 'shop.example.com' AS site, '(555) ' || lpad((p_partkey % 1000)::VARCHAR, 3, '0') || '-0000' AS value FROM part WHERE p_partkey % 2 = 0
UNION SELECT 'shop.example.com', '(555) ' || lpad((p_partkey % 500)::VARCHAR, 3, '0') || '-0000' FROM part WHERE p_partkey % 2 = 1
"""


@register("merge_phones", MERGE_PHONES_SQL)
def merge_phones(spark, sf_dir):
    """U2 on phone numbers found in two runs of pages."""
    from sitelens.plans.detail_plans import detail_pages

    p = detail_pages(spark, sf_dir)

    def found(run, modulus):
        number = F.concat(F.lit("<p>(555) "), F.lpad((F.col("page_id") % modulus).cast("string"), 3, "0"), F.lit("-0000</p>"))
        return X.phones(run.withColumn("html", number)).select("site", F.col("phone").alias("value"))

    old, new = found(p.where("page_id % 2 = 0"), 1000), found(p.where("page_id % 2 = 1"), 500)
    return M.union_sets(old.distinct(), new, "value")
