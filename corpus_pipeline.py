"""The corpus pipeline: quality classifier, SimHash near-dedup, benchmark decontamination, secret scan, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared
folder and rereads it as the next stage's docs. All but the last return the columns of ``documents``. A stage
works on all that its predecessor kept:

* quality: documents that the classifier rejects go (score below 0.3);
* simhash: of each group of linked fingerprints the document with the smallest id stays;
* decontaminate: documents with a benchmark window go;
* secrets: live values and widely copied examples are replaced by placeholders, all documents stay;
* pack: documents become pieces with their place in a sequence.

Rows are told apart by id and text: repeated rows of the same id and text share every decision (of
such a group of copies the dedup keeps one). A null id is the largest.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm import decontaminate, packing, quality_trees, secret_scan, simhash
from sitelens.llm.common import broadcast_within, prepare, read_table, store

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
FEW = 5_000_000  # rows of two longs that may be broadcast


def identified(docs: DataFrame) -> DataFrame:
    """The columns of documents and ``_key``: what tells rows apart, in the order that decides who stays."""
    key = F.struct(
        F.col("doc_id").isNull().alias("no_id"),
        F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"),
    )
    return docs.select(*COLUMNS).withColumn("_key", key)


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows whose ``_key`` is not among the keys of ``dropped`` (``_gone``)."""
    gone = broadcast_within(dropped.select(F.col("_gone.*")).distinct(), FEW)
    same = (F.col("_key.no_id") == F.col("no_id")) & (F.col("_key.id") == F.col("id")) & (F.col("_key.h") == F.col("h"))
    return docs.join(gone, same, "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the quality classifier (operator 5) does not reject."""
    prepare(spark)
    model = quality_trees.train(docs, read_table(spark, sf_dir, "labels"), "doc_id", "text", "quality")
    return docs.select(*COLUMNS).filter(quality_trees.score_column(model, F.col("text")) >= 0.3)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the one with the smallest id, of each SimHash group (operator 3)."""
    prepare(spark)
    docs = identified(docs)
    linked = store(simhash.link(docs, "_key", "text", words=3, radius=2).select("_key", "component_id"), "linked")
    kept = without(docs, linked.filter("_key != component_id").select(F.col("_key").alias("_gone")))
    repeated = linked.filter("_key = component_id").groupBy("_key").count().filter("count > 1")
    repeated = store(repeated.select(F.col("_key").alias("_gone")), "repeated")
    if repeated.limit(1).count() == 0:
        return kept.select(*COLUMNS)
    single = without(kept, repeated)
    others = kept.join(repeated, F.col("_key") == F.col("_gone"), "left_semi").dropDuplicates(["_key"])
    return single.unionByName(others).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents without any benchmark window (operator 4)."""
    prepare(spark)
    docs = identified(docs)
    found = decontaminate.report(docs, read_table(spark, sf_dir, "benchmark"), key="_key")
    hit = store(found.filter("n_hit > 0").select(F.col("_key").alias("_gone")), "contaminated")
    return without(docs, hit).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by placeholders (operator 2); every document stays."""
    prepare(spark)
    docs = docs.select(*COLUMNS).withColumn("_repo", F.concat_ws("/", "source", "lang"))
    masked = secret_scan.redact(secret_scan.scan(docs, "text", owner="source", repo="_repo"), "text")
    n_chars = F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return masked.withColumn("n_chars", n_chars).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their places in sequences (operator 8)."""
    prepare(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    # workers that served the earlier stages have less memory to spare than a fresh one
    pieces = packing.tokenize(docs, "doc_id", "text", path, end_id=1, capacity=4096, words=100_000)
    return packing.pack(pieces, capacity=4096)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("pack", pack),
]

#: SQL expresses neither the trained model nor the hash; the stages are tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
