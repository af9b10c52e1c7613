"""Domain-queue queries.

The queue is the page store's sites in order of first appearance; a
hand-edited copy (padding, blank and comment lines) is written as text, loaded
back, extended with the fetch log's sites, and half of it marked completed.
Batch outcomes come from the event log, one domain per user.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelens.plans import sqlparts as S
from sitelens.plans.registry import register
from sitelens.sinks import writers as W
from sitelens.sources import queue as QU
from sitelens.sources.pages import load_pages, read_table


def _initial(spark, sf_dir):
    sites = load_pages(spark, sf_dir).groupBy("site").agg(F.min("page_id").alias("first"))
    return QU.number_rows(sites, ["first", "site"]).select("pos", F.col("site").alias("domain"))


def _edited_text(queue):
    """Queue text as a person edits it: padded names, blank and comment lines."""
    spark = queue.sparkSession
    body = queue.select(
        (F.col("pos") * 3).alias("k"),
        F.when(F.col("pos") % 3 == 0, F.concat(F.lit("  "), F.col("domain"), F.lit(" "))).otherwise(F.col("domain")).alias("value"),
    )
    extra = queue.where(F.col("pos") % 4 == 0).select((F.col("pos") * 3 + 1).alias("k"), F.lit("").alias("value")).unionByName(
        queue.where(F.col("pos") % 5 == 0).select((F.col("pos") * 3 + 2).alias("k"), F.lit("# checked").alias("value"))
    )
    head = spark.createDataFrame([(-2, W.QUEUE_HEADER[0]), (-1, W.QUEUE_HEADER[1])], "k long, value string")
    return head.unionByName(body).unionByName(extra)


def _new_domains(spark, sf_dir):
    """Fetch-log sites, two already queued sites and one in-list duplicate."""
    ev = read_table(spark, sf_dir, "events").select(F.concat(F.lit("site"), (F.col("user_id") % 5).cast("string"), F.lit(".example.com")).alias("domain"))
    ev = ev.distinct().select((F.lit(10) + F.substring("domain", 5, 1).cast("int")).alias("pos"), F.concat(F.lit(" "), "domain").alias("domain"))
    q = _initial(spark, sf_dir).where(F.col("pos") <= 2).select("pos", "domain")
    dup = ev.where(F.col("pos") == 10).select(F.lit(30).alias("pos"), "domain")
    return ev.unionByName(q).unionByName(dup)


def _loaded(spark, sf_dir):
    q = _initial(spark, sf_dir)
    path = W.scratch_path(spark, "queue")
    _edited_text(q).repartitionByRange(3, "k").sortWithinPartitions("k").select("value").write.mode("overwrite").text(path)
    loaded = QU.load_queue(spark, path)
    return QU.add_to_queue(loaded, _new_domains(spark, sf_dir))


QUEUE_CTE = f"""
{S.pages_cte()},
q0 AS (SELECT row_number() OVER (ORDER BY min(page_id), site) AS pos, site AS domain FROM pg GROUP BY site),
nw AS (SELECT DISTINCT 'site' || (user_id % 5) || '.example.com' AS domain FROM events),
add AS (SELECT (SELECT max(pos) FROM q0) + row_number() OVER (ORDER BY domain) AS pos, domain FROM nw WHERE domain NOT IN (SELECT domain FROM q0)),
q AS (SELECT * FROM q0 UNION ALL SELECT * FROM add)"""


@register("queue_load_add_remaining", f"WITH {QUEUE_CTE} SELECT pos, domain FROM q WHERE pos % 2 = 1")
def queue_load_add_remaining(spark, sf_dir):
    """S2 + S3 + U10 + J12: load an edited queue file, add domains, drop completed ones."""
    q = _loaded(spark, sf_dir)
    completed = q.where(F.col("pos") % 2 == 0).select("domain")
    return QU.remaining(q, completed)


@register("queue_listing", f"WITH {QUEUE_CTE} SELECT row_number() OVER (ORDER BY pos) AS ordinal, domain FROM q WHERE pos % 3 <> 0")
def queue_listing(spark, sf_dir):
    """1-based listing of the queue after every third entry was processed."""
    q = _loaded(spark, sf_dir)
    return QU.listing(q.where(F.col("pos") % 3 != 0))


@register("queue_saved", """
WITH l AS (SELECT -2 AS p, '# Crawl queue - domains to process' AS line UNION ALL SELECT -1, '# Format: domain'
           UNION ALL SELECT c_custkey, 'u' || c_custkey || '.example.com' FROM customer)
SELECT row_number() OVER (ORDER BY p) AS n, line FROM l
""")
def queue_saved(spark, sf_dir):
    """A queue of one domain per customer, saved and read back line by line."""
    from sitelens.sinks.writers import scratch_path, write_queue

    k = F.col("c_custkey")
    queue = read_table(spark, sf_dir, "customer").select(
        k.cast("long").alias("pos"), F.concat(F.lit("u"), k.cast("string"), F.lit(".example.com")).alias("domain")
    )
    path = scratch_path(spark, "queue-saved")
    write_queue(queue, path)
    return QU.load_lines(spark, path).select(F.col("pos").alias("n"), F.col("value").alias("line"))


OUTCOME_CTE = """o AS (
  SELECT 'u' || user_id || '.example.com' AS domain,
         (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds,
         count(*) FILTER (WHERE event_type = 'error') <= 0.25 * count(*) AS success
  FROM events GROUP BY user_id)"""


def _outcomes(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.groupBy("user_id").agg(
        ((F.max(us) - F.min(us)) / 1e6).alias("seconds"),
        (F.count_if(F.col("event_type") == "error") <= 0.25 * F.count(F.lit(1))).alias("success"),
    ).select(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".example.com")).alias("domain"), "seconds", "success")


ROLLUP_SQL = f"""
WITH {OUTCOME_CTE}
SELECT count(*) FILTER (WHERE success) AS completed, count(*) FILTER (WHERE NOT success) AS failed,
       round(avg(seconds) FILTER (WHERE success), 3) AS avg_seconds, round(min(seconds) FILTER (WHERE success), 3) AS min_seconds,
       round(max(seconds) FILTER (WHERE success), 3) AS max_seconds,
       (SELECT count(*) FROM customer WHERE 'u' || c_custkey || '.example.com' NOT IN (SELECT domain FROM o WHERE success)) AS remaining
FROM o
"""


@register("batch_rollup", ROLLUP_SQL)
def batch_rollup(spark, sf_dir):
    """Completed / failed domains, completed crawl seconds, and what remains of a queue of one domain per customer."""
    k = F.col("c_custkey")
    queue = read_table(spark, sf_dir, "customer").select(
        k.cast("long").alias("pos"), F.concat(F.lit("u"), k.cast("string"), F.lit(".example.com")).alias("domain")
    )
    r = QU.batch_rollup(_outcomes(spark, sf_dir), queue)
    return r.select("completed", "failed", "remaining", *[F.round(c, 3).alias(c) for c in ("avg_seconds", "min_seconds", "max_seconds")])


SLOW_SQL = f"""
WITH {OUTCOME_CTE}
SELECT domain, round(seconds, 3) AS seconds FROM o WHERE success ORDER BY seconds DESC, domain LIMIT 5
"""


@register("slowest_domains", SLOW_SQL)
def slowest_domains(spark, sf_dir):
    """The five slowest completed domains (only shown when more than five completed)."""
    return QU.slowest(_outcomes(spark, sf_dir)).select("domain", F.round("seconds", 3).alias("seconds"))
