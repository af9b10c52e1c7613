"""Page store source (S1): the table of fetched pages every operator reads.

Input contract: ``pages(page_id, url, html)`` plus optional fetch columns. Missing
optional columns are added as typed NULLs so every operator sees one schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.functions.urls import site_of
from sitelens.session import table_path

#: Session setting, unset by default: deal the page source to so many partitions. For a source that
#: lies in fewer files or row groups than there are cores; a store of many files is read as it lies.
PARTITIONS = "spark.sitelens.input.partitions"

#: Rows a task when pages are composed from a table (see ``dealt``).
ROWS_A_TASK = 8192

OPTIONAL_COLUMNS = {
    "status_code": "int",
    "content_type": "string",
    "headers": "map<string,string>",
    "response_time": "double",
    "elapsed": "double",
    "fetched_at": "timestamp_ntz",
    "redirects": "array<string>",
    "error": "string",
    "error_type": "string",
    "depth": "int",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def dealt(rows: DataFrame, key: str, each: int | None = None) -> DataFrame:
    """``rows`` in partitions of about ``each`` (``ROWS_A_TASK``) rows, by a hash of ``key``.

    For a narrow table whose rows each become a page: its files are too small for Spark to cut by their bytes (a million
    rows lie in one row group of a few MB), though the pages made of them are a thousand times the work. The rows
    are dealt before the markup is made, so the shuffle moves the narrow columns only."""
    parts = -(-rows.count() // (each or ROWS_A_TASK))
    if parts <= max(rows.rdd.getNumPartitions(), 1):
        return rows
    return rows.repartition(parts, key)


def conform_pages(pages: DataFrame, site: str | None = None) -> DataFrame:
    """Add the ``site`` key and typed NULLs for absent fetch columns.

    ``site`` is a literal target domain when given (one crawl), otherwise it is
    derived per page from its URL (a page store holding many sites).
    """
    df = pages
    parts = df.sparkSession.conf.get(PARTITIONS, None)
    if parts:
        df = df.repartition(int(parts))
    if "site" not in df.columns:
        df = df.withColumn("site", F.lit(site) if site else site_of(F.col("url")))
    for name, dtype in OPTIONAL_COLUMNS.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(dtype))
    return df


def load_pages(spark: SparkSession, sf_dir: str, site: str | None = None) -> DataFrame:
    return conform_pages(read_table(spark, sf_dir, "pages"), site)


def page_bytes(html_col=None):
    """Body size in bytes (``len(response.content)``) when no size is stored."""
    return F.octet_length(html_col if html_col is not None else F.col("html")).cast("bigint")
