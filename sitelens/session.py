"""Session helpers: the settings every sitelens job assumes, and where lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings a job relies on. AQE re-plans joins (broadcast vs sort-merge) from
# runtime sizes, splits skewed shuffle partitions and coalesces tiny ones.
ENGINE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # a union that passes its children's partitioning on can fail a join's check once partitions are coalesced
    "spark.sql.unionOutputPartitioning": "false",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "sitelens") -> SparkSession:
    """Local session for tests and the bench (the UI stays off: no server)."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in ENGINE_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    On a cluster the deployment sets it and it is only read here; without it there is no
    folder that all executors see, so the call fails. A local session (tests), where driver
    and executors are one process, gets a scratch folder of its own.
    """
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        current = tempfile.mkdtemp(prefix="sitelens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table below the shared folder and read it back: lineage ends at files that
    every executor can reach, and later plans know the table's size."""
    path = os.path.join(ensure_checkpoint_dir(df.sparkSession), f"sitelens-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


class session_conf:
    """Temporarily set SQL confs (restored on exit), e.g. the number of state
    partitions a new streaming checkpoint is created with."""

    def __init__(self, spark: SparkSession, conf: dict[str, str]):
        self.spark, self.conf, self.saved = spark, conf, {}

    def __enter__(self):
        for k, v in self.conf.items():
            self.saved[k] = self.spark.conf.get(k, None)
            self.spark.conf.set(k, v)
        return self.spark

    def __exit__(self, *exc):
        for k, v in self.saved.items():
            if v is None:
                self.spark.conf.unset(k)
            else:
                self.spark.conf.set(k, v)
        return False
