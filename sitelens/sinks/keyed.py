"""Keyed tables that grow batch by batch.

A table is cut into buckets by a hash of its key. A batch reads the buckets that it touches, merges its rows into
them and writes them anew under the batch's number; a small list then says which number holds each bucket. Readers
follow the newest list, so

* a read costs one version of each bucket, however many batches came before;
* a batch is in force once its list is written, and not before; a retried batch starts from the list of its
  predecessors and replaces what its first try wrote, so it changes nothing twice.

Choose ``buckets`` so that one bucket's rows suit a task. Versions that no list needs can be dropped (``vacuum``).
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class KeyedTable:
    """``merge(old_rows, new_rows)`` gives a touched bucket's rows; both hold whole keys."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path, list(keys), buckets
        self.schema = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema

    # ---- versions

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _numbers(self, folder: str) -> list[int]:
        """Batch numbers with a finished write in ``folder``."""
        fs, path = self._fs()
        root = path(os.path.join(self.path, folder))
        if not fs.exists(root):
            return []
        done = [s.getPath() for s in fs.listStatus(root) if fs.exists(path(s.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName().split("=")[1]) for p in done)

    def _places(self, before: int | None = None) -> dict[int, int]:
        """Bucket → number that holds it, as the newest list (before a batch) says: at most ``buckets`` entries."""
        lists = [n for n in self._numbers("lists") if before is None or n < before]
        if not lists:
            return {}
        rows = self.spark.read.schema("bucket int, version long").parquet(os.path.join(self.path, "lists", f"n={lists[-1]}"))
        return {r["bucket"]: r["version"] for r in rows.collect()}

    def _read(self, places: dict[int, int]) -> DataFrame:
        paths = [os.path.join(self.path, "rows", f"n={n}", f"bucket={b}") for b, n in sorted(places.items())]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    # ---- use

    def current(self) -> DataFrame:
        return self._read(self._places())

    def bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame, number: int) -> tuple[list[int], DataFrame]:
        """(buckets of the keys in ``rows``, what the table held in them before batch ``number``)."""
        buckets = [r[0] for r in rows.select(self.bucket().alias("bucket")).distinct().collect()]  # at most ``buckets``
        places = self._places(number)
        return buckets, self._read({b: places[b] for b in buckets if b in places})

    def put(self, rows: DataFrame, number: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Merge batch ``number`` into the table."""
        buckets, held = self.touched(rows, number)
        names = self.schema.fieldNames()
        merged = merge(held, rows.select(*names)).select(*names).withColumn("bucket", self.bucket())
        # a bucket's rows meet in one task; the write is by bucket
        merged.repartition(self.buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(os.path.join(self.path, "rows", f"n={number}"))
        self._list({**self._places(number), **dict.fromkeys(buckets, number)}, number)

    def _list(self, places: dict[int, int], number: int) -> None:
        rows = self.spark.createDataFrame(sorted(places.items()), "bucket int, version long")
        rows.coalesce(1).write.mode("overwrite").parquet(os.path.join(self.path, "lists", f"n={number}"))

    def vacuum(self, keep: int = 2) -> None:
        """Drop versions that none of the newest ``keep`` lists needs, so that readers of those lists still find theirs."""
        fs, path = self._fs()
        lists = self._numbers("lists")
        needed = {(b, n) for k in lists[-keep:] for b, n in self._places(k + 1).items()}
        for k in lists[:-keep]:
            fs.delete(path(os.path.join(self.path, "lists", f"n={k}")), True)
        for n in self._numbers("rows"):
            if lists and n > lists[-1]:
                continue  # a batch under way
            for s in fs.listStatus(path(os.path.join(self.path, "rows", f"n={n}"))):
                name = s.getPath().getName()
                if name.startswith("bucket=") and (int(name.split("=")[1]), n) not in needed:
                    fs.delete(s.getPath(), True)


def replace_by_key(keys: list[str], order_cols: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Of each key the row with the greatest ``order_cols``."""
    from sitelens.operators import merge as M

    return lambda held, rows: M.latest_rows(held.unionByName(rows), keys, order_cols)


def insert_if_absent(keys: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Keys that are held stay as they are."""
    return lambda held, rows: held.unionByName(rows.join(held.select(*keys), keys, "left_anti"))


def overwrite_keys(keys: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """U4: rows of new keys replace the held ones."""
    return lambda held, rows: held.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows)
