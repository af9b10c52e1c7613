import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """documents from (doc_id, text[, lang[, source]]) rows, with extra columns of clashing names."""

    def make(rows, partitions=3):
        from pyspark.sql import functions as F

        from sitelens.llm.common import prepare

        prepare(spark)
        full = [(*r, "en", "src0")[:4] if len(r) == 2 else (*r, "src0")[:4] for r in rows]
        full = [(*r, len(r[1]) if r[1] is not None else None) for r in full]
        df = spark.createDataFrame(full, DOCS).repartition(partitions)
        clash = ("key", "h", "row", "rid", "fp", "term", "pos", "word", "spans", "label", "score", "kept", "wid", "block", "stats")
        return df.withColumns({c: F.lit("x") for c in clash})

    return make


@pytest.fixture
def sf(spark, tmp_path):
    """A folder of tables, as the queries take it."""

    def make(**tables):
        for name, df in tables.items():
            df.write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return make
