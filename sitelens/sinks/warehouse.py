"""The eight result tables.

Every table has a dense ``id`` that goes on from the largest one already written, and the
urls table holds HTML pages only. Pages are read once for all tables of facts and once for keywords;
what they hold is kept by page (markup is not), and tables are written from it one after the other.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from sitelens.operators import extract as X
from sitelens.operators import fetch as FT
from sitelens.operators import keywords as K
from sitelens.operators.elements import mask_html
from sitelens.session import written
from sitelens.sinks.writers import with_ids, write_table
from sitelens.sources.queue import path_exists

TABLES = ["urls", "keywords", "links", "technologies", "files", "forms", "images", "subdomains"]


def page_facts(pages: DataFrame) -> DataFrame:
    """What the pages of a run hold, all but its keywords: one row a page, read in one pass and written once. The tables of facts
    (see ``warehouse_table``) are made of it, a retried append as well."""
    kept = ["status_code", "content_type", "depth", "response_time", "fetched_at"]
    found = X.page_rows(pages, keep=[F.octet_length("html").cast("bigint").alias("size"), *kept])
    columns = ["page_id", "url", "site", *kept, "size", "title", "description", "keywords", "_h1", "_links", "_forms", "_images", "_anchors", "_techs"]
    return written(found.select(*columns), "page-facts")


def warehouse_table(name: str, pages: DataFrame, facts: DataFrame | None = None, subdomains: DataFrame | None = None) -> DataFrame:
    """One table (columns of the original DDL, plus ``site``) from ``pages``, or from their ``page_facts``."""
    el = pages if facts is None else facts
    if name == "urls":
        if facts is None:
            stored = pages.withColumns({"_m": mask_html(F.col("html")), "size": F.octet_length("html").cast("bigint")})
            el = X.metadata(X.with_h1(stored, "_m", "_h1"), keep=["status_code", "content_type", "size", "depth", "_h1", "response_time", "fetched_at"])
        return el.where(FT.is_html(F.coalesce("content_type", F.lit("text/html")))).select(
            "site", "url", "status_code", "content_type", "size", "depth", "title", "description", "keywords",
            F.to_json("_h1").alias("h1_tags"), "response_time", F.col("fetched_at").alias("timestamp"),
        )
    if name == "keywords":
        return K.page_top_keywords(pages).select("site", "keyword", "frequency", "url")
    if name == "links":
        return X.links(el).select("site", "source_url", "target_url", "anchor_text", "link_type")
    if name == "technologies":
        return X.technologies(el).select("site", "url", "technology", F.lit("").alias("version"))
    if name == "files":
        return X.files(el).select("site", "url", "file_type", "file_path", F.lit(0).cast("bigint").alias("file_size"))
    if name == "forms":
        return X.forms(el).select("site", "url", "action", "method", F.to_json("fields").alias("fields"))
    if name == "images":
        return X.images(el).select("site", "url", "src", "alt", "title")
    subs = subdomains if subdomains is not None else pages.sparkSession.createDataFrame([], "site string, subdomain string, ip string")
    return subs.select("site", "subdomain", F.col("ip").alias("ip_address"), F.current_timestamp().cast("timestamp_ntz").alias("discovered_at"))


def warehouse_tables(pages: DataFrame, subdomains: DataFrame | None = None, facts: DataFrame | None = None) -> dict[str, DataFrame]:
    """The table DataFrames by name."""
    return {name: warehouse_table(name, pages, facts, subdomains) for name in TABLES}


def write_rows(df: DataFrame, path: str, mode: str = "append", run: int | None = None) -> DataFrame:
    """S10 + S11: append (or overwrite) one table, ids going on from the largest stored one.
    With a ``run`` number the rows are that run's part of the table: written once more, they replace themselves,
    with ids that go on from the runs before. Returns the rows' frame for its schema."""
    spark, start = df.sparkSession, 1
    if mode == "append" and path_exists(spark, path):
        stored = spark.read.schema("id long" if run is None else "id long, run int").parquet(path)
        if run is not None:
            stored = stored.where(F.col("run") < run)
        start = (stored.agg(F.max("id")).first()[0] or 0) + 1  # one scalar
    numbered = with_ids(df, start)
    write_table(numbered, path if run is None else os.path.join(path, f"run={run}"), mode=mode if run is None else "overwrite")
    return numbered


def write_warehouse(
    pages: DataFrame, path: str, mode: str = "overwrite", subdomains: DataFrame | None = None, run: int | None = None,
    facts: DataFrame | None = None,
) -> dict:
    """Write all tables under ``path/<table>``, or the part of run ``run``; returns their schemas (with the
    bucket column, and the run's) for reading back. ``facts`` are the pages' own, if they are written already."""
    schemas = {}
    for name, df in warehouse_tables(pages, subdomains, page_facts(pages) if facts is None else facts).items():
        written = write_rows(df, os.path.join(path, name), mode, run)
        schemas[name] = written.schema.add("site_bucket", IntegerType()) if "site" in written.columns else written.schema
        if run is not None:
            schemas[name] = schemas[name].add("run", IntegerType())
    return schemas
