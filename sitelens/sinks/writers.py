"""Sinks: result document (S4), text report (S5), URL CSV (S6), warehouse tables
(S7, S10, S11), per-domain output names (S15), queue file (S3).

All writes are distributed DataFrame writes, partitioned by site where the
original wrote one file per domain. Scratch output goes below the shared
checkpoint folder, never to a machine-local temp directory.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelens.functions.lookups import FILE_EXTENSIONS
from sitelens.session import ensure_checkpoint_dir, written

# FIXED VALUES: header of the URL CSV.
URL_CSV_HEADER = ["URL", "Status Code", "Content Type", "Size (bytes)", "Depth", "Response Time", "Title"]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir`` (shared storage on a cluster)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "sitelens-out", f"{name}-{uuid.uuid4().hex[:12]}")


def output_name(site) -> F.Column:
    """``crawl_results_{domain with '.' → '_'}``."""
    return F.concat(F.lit("crawl_results_"), F.replace(site, F.lit("."), F.lit("_")))


# ---- S4: result document -------------------------------------------------------

LISTED = 1000  # values of a list in a document; all of them belong in a section of their own


def first_values(df: DataFrame, value: str, name: str, limit: int = LISTED) -> DataFrame:
    """(site, list): the first ``limit`` distinct values of each site in sort order."""
    rank = F.row_number().over(Window.partitionBy("site").orderBy(value))
    first = df.select("site", value).distinct().withColumn("_r", rank).where(F.col("_r") <= limit)
    return first.groupBy("site").agg(F.sort_array(F.collect_list(value)).alias(name))


def result_document(stats: DataFrame, top_keywords: DataFrame, bounded_sets: dict[str, DataFrame],
                    agent_mode: str = "pc") -> DataFrame:
    """One JSON-able row per site holding only bounded sections: the statistics
    struct, the top-k keyword map and lists capped by construction (first 1000
    endpoints, enumerated subdomains). Unbounded sections (e-mails, phones, API
    endpoints, per-URL technologies, forms, files …) are written by
    ``write_document`` as one-row-per-item datasets instead, so no site — however
    large — is ever collected into a single row or task."""
    stat_cols = [c for c in stats.columns if c != "site"]
    doc = stats.select("site", F.struct(*stat_cols).alias("statistics"))
    kw = top_keywords.groupBy("site").agg(
        F.map_from_entries(F.transform(F.sort_array(F.collect_list(F.struct("rank", "keyword", "frequency"))),
                                       lambda x: F.struct(x["keyword"], x["frequency"]))).alias("top_keywords")
    )
    doc = doc.join(kw, "site", "left")
    for name, df in bounded_sets.items():
        value = [c for c in df.columns if c != "site"][0]
        doc = doc.join(first_values(df, value, name), "site", "left")
    return doc.select(
        F.col("site").alias("target_domain"), F.lit(agent_mode).alias("crawler_mode"),
        *[c for c in doc.columns if c != "site"], output_name(F.col("site")).alias("output_name"),
    )


def full_document(doc: DataFrame, maps: dict[str, DataFrame], lists: dict[str, DataFrame],
                  tables: dict[str, tuple[DataFrame, list[str], int]], crawler_name: str, timestamp: str) -> DataFrame:
    """S4 with its other bounded sections, joined to ``result_document`` rows by site:

    * ``maps``: (site, key, n) histograms such as status codes, errors and content types, in key order (T7);
    * ``lists``: (site, value) the first ``LISTED`` distinct values in sort order, such as enumerated subdomains (T8);
    * ``tables``: the first so many rows by the order given, such as 100 SEO rows and 500 URL rows (T4).

    Histograms have a row per distinct key and tables a limit, so every section of a site is small."""
    out = doc.withColumns({"crawler_name": F.lit(crawler_name), "timestamp": F.lit(timestamp)})
    sections = {}
    for name, df in maps.items():
        entries = F.sort_array(F.collect_list(F.struct(F.col("key").cast("string").alias("key"), F.col("n").cast("bigint").alias("n"))))
        sections[name] = df.groupBy("site").agg(F.map_from_entries(entries).alias(name))
    for name, df in lists.items():
        sections[name] = first_values(df, "value", name)
    for name, (df, order, limit) in tables.items():
        rank = F.row_number().over(Window.partitionBy("site").orderBy(*order))
        first = df.withColumn("_r", rank).where(F.col("_r") <= limit)
        item = F.struct("_r", *[c for c in df.columns if c != "site"])
        rows = F.transform(F.sort_array(F.collect_list(item)), lambda x: x.dropFields("_r"))
        sections[name] = first.groupBy("site").agg(rows.alias(name))
    for name, df in sections.items():
        out = out.join(df.withColumnRenamed("site", "target_domain"), "target_domain", "left")
    return out


def write_document(doc: DataFrame, path: str, sections: dict[str, DataFrame] | None = None) -> None:
    """S4 + S15: the bounded document per domain under ``document/``, and every
    unbounded section as JSON lines under ``<section>/``, all partitioned by the
    per-domain output name."""
    doc.write.mode("overwrite").partitionBy("output_name").json(os.path.join(path, "document"))
    for name, df in (sections or {}).items():
        out = df.withColumn("output_name", output_name(F.col("site")))
        out.write.mode("overwrite").partitionBy("output_name").json(os.path.join(path, name))


def read_document(spark: SparkSession, path: str, schema: str, section: str = "document") -> DataFrame:
    """A section of prior results. A section that is missing, or that holds a line which is no
    JSON, counts as no prior results, so a merge overwrites it, as the original does."""
    from sitelens.sources.queue import path_exists

    at = os.path.join(path, section)
    if not path_exists(spark, at):
        return spark.createDataFrame([], schema)
    bad = "_bad_line"
    rows = spark.read.schema(f"{schema}, {bad} string").option("columnNameOfCorruptRecord", bad).json(at)
    broken = bool(rows.where(F.col(bad).isNotNull()).take(1))
    return rows.drop(bad).limit(0) if broken else rows.drop(bad)


# ---- S5: report lines ----------------------------------------------------------

#: Sections of a report in order; the statistics have no count in their title.
REPORT_SECTIONS = ["Statistics", "Subdomains", "Top Keywords", "Technologies", "Emails", "Social Media", "Files", "API Endpoints"]


def report_lines(stats_long: DataFrame, top_keywords: DataFrame, lists: dict[str, DataFrame], files: DataFrame | None = None,
                 timestamp: str = "") -> DataFrame:
    """(site, section, ord, line) rows; a report is these lines in (section, ord, line) order.

    Section 0 is the header, then come the sections of ``REPORT_SECTIONS``, each with its title (and count)
    first: statistics, ``lists`` of (site, value) by section name, the first 50 keywords, and per file type its
    count and first 20 files by position. Sorted lists use one ``ord`` and sort by the line itself, so no
    per-site window is needed."""
    number = {name: i for i, name in enumerate(REPORT_SECTIONS, 1)}

    def rows(df: DataFrame, section: int, order, line) -> DataFrame:
        return df.select("site", F.lit(section).alias("section"), order.cast("long").alias("ord"), line.alias("line"))

    def titled(df: DataFrame, name: str, order, line) -> list[DataFrame]:
        heads = df.groupBy("site").agg(F.count("*").alias("n"))
        title = F.concat(F.lit(f"{name} ("), F.col("n").cast("string"), F.lit("):"))
        return [rows(heads, number[name], F.lit(-1), title), rows(df, number[name], order, line)]

    named = F.initcap(F.replace(F.col("stat"), F.lit("_"), F.lit(" ")))
    sites = stats_long.select("site").distinct()
    parts = [
        rows(sites, 0, F.lit(0), F.concat(F.lit("Crawl report: "), F.col("site"))),
        rows(sites, 0, F.lit(1), F.lit(f"Generated: {timestamp}")),
        rows(sites, 1, F.lit(-1), F.lit("Statistics:")),
        rows(stats_long, 1, F.col("ord"), F.concat(F.lit("  "), named, F.lit(": "), F.col("value").cast("string"))),
        *titled(top_keywords.where(F.col("rank") <= 50), "Top Keywords", F.col("rank"),
                F.concat(F.lit("  "), F.col("keyword"), F.lit(": "), F.col("frequency").cast("string"))),
    ]
    # what pages yield is asked several times, and once more when the lines are dealt by range: it is written once
    for name, df in lists.items():
        parts += titled(written(df.select("site", "value").distinct(), "report-list"), name, F.lit(0), F.concat(F.lit("  - "), F.col("value")))
    if files is not None:
        files = written(files.select("site", "file_type", "file_path", "page_id", "seq"), "report-files")
        kinds = files.groupBy("site", "file_type").agg(F.count("*").alias("n"))
        order = Window.partitionBy("site", "file_type").orderBy("page_id", "seq")
        first = files.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= 20)
        kind_line = F.concat(F.lit("  "), F.upper("file_type"), F.lit(" ("), F.col("n").cast("string"), F.lit("):"))
        # one block of lines a type: ord is the type's place in the list of extensions
        place = lambda c: 100 * F.array_position(F.array(*[F.lit(e[1:]) for e in FILE_EXTENSIONS]), c)
        total = files.groupBy("site").agg(F.count("*").alias("n"))
        parts += [
            rows(total, number["Files"], F.lit(-1), F.concat(F.lit("Files ("), F.col("n").cast("string"), F.lit("):"))),
            rows(kinds, number["Files"], place(F.col("file_type")), kind_line),
            rows(first, number["Files"], place(F.col("file_type")) + F.col("_r"), F.concat(F.lit("    - "), F.col("file_path"))),
        ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def write_report(lines: DataFrame, path: str, files: int | None = None) -> None:
    """One text report per domain. Range partitioning on (name, section,
    ord, line) keeps every part file in report order, and a large site spans
    several files instead of one task."""
    n = files or lines.sparkSession.sparkContext.defaultParallelism
    # the rows are sorted by the column that names their folder: the writer would otherwise sort
    # them by it once more, and that sort does not keep the order of a report
    keys = ["output_name", "section", "ord", "line"]
    named = lines.withColumn("output_name", output_name(F.col("site")))
    out = named.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    out.select("output_name", "line").write.mode("overwrite").partitionBy("output_name").text(path)


# ---- S6: URL CSV -----------------------------------------------------------------

def url_csv_rows(results: DataFrame, metadata: DataFrame) -> DataFrame:
    """S6 + J6: result rows left-joined with metadata titles; blanks for missing."""
    j = results.join(metadata.select("url", "title"), "url", "left")
    cols = ["url", "status_code", "content_type", "size", "depth", "response_time", "title"]
    return j.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(h) for c, h in zip(cols, URL_CSV_HEADER)])


def write_csv(df: DataFrame, path: str) -> None:
    # quotes inside a value are doubled, as CSV readers expect
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


# ---- S7, S10, S11: warehouse tables ---------------------------------------------

def with_ids(df: DataFrame, start: int = 1) -> DataFrame:
    """Surrogate ids ``start``, ``start`` + 1, … in the order of the rows as they come."""
    from sitelens.sources.queue import number_rows

    return number_rows(df, [], start=start, name="id")


def write_table(df: DataFrame, path: str, mode: str = "append", bucket_col: str = "site", buckets: int = 64) -> None:
    """Append (or overwrite) a warehouse table as Parquet, partitioned by a
    hash bucket of the site so that site filters prune files."""
    out = df
    if bucket_col in df.columns:
        out = df.withColumn("site_bucket", F.pmod(F.xxhash64(bucket_col), F.lit(buckets)).cast("int"))
        # one bucket's rows meet in few tasks (AQE splits a hot one), so files do not multiply
        out = out.hint("rebalance", "site_bucket")
        out.write.mode(mode).partitionBy("site_bucket").parquet(path)
    else:
        out.write.mode(mode).parquet(path)


# ---- S3: queue file --------------------------------------------------------------

# FIXED VALUES: comment lines of a queue file.
QUEUE_HEADER = ["# Crawl queue - domains to process", "# Format: domain"]


def queue_text(queue: DataFrame) -> DataFrame:
    """S3: two comment lines then one domain per line, in queue order."""
    head = queue.sparkSession.createDataFrame([(i - len(QUEUE_HEADER), h) for i, h in enumerate(QUEUE_HEADER)], "pos long, value string")
    return head.unionByName(queue.select(F.col("pos").cast("long"), F.col("domain").alias("value")))


def write_queue(queue: DataFrame, path: str, files: int | None = None) -> None:
    """Range-partitioned on position (``files`` parts, or as many as Spark finds fit): part files are
    written in queue order and lines keep their order inside each file (read back by ``load_queue``)."""
    text = queue_text(queue)
    text = (text.repartitionByRange(files, "pos") if files else text.repartitionByRange("pos")).sortWithinPartitions("pos")
    text.select("value").write.mode("overwrite").text(path)
