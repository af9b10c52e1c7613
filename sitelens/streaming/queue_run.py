"""Processing a queue of domains so that it can be resumed.

A run takes the next ``per_step`` domains of the queue at a time and crawls them in one pass. Each step writes its result rows
and then one ledger row a domain, both under the step's number. What the ledger has as completed is never crawled
again; a domain without result rows is entered as failed and stays in the queue for the next run. A run that breaks off in a
step leaves no ledger rows of it, so the next one repeats that step, over what it had written.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from sitelens.session import written
from sitelens.sources.queue import path_exists, remaining

LEDGER = "domain string, status string, pages long, seconds double, step int"


@dataclass
class QueueRun:
    spark: SparkSession
    path: str

    def ledger(self) -> DataFrame:
        """One row a domain and try: domain, status, pages, seconds, step."""
        at = os.path.join(self.path, "ledger")
        if not path_exists(self.spark, at):
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(at)

    def completed(self) -> DataFrame:
        return self.ledger().where("status = 'completed'")

    def results(self, schema: StructType) -> DataFrame:
        """Result rows of the steps that the ledger has."""
        steps = [r["step"] for r in self.ledger().select("step").distinct().collect()]
        at = os.path.join(self.path, "results")
        if not steps:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(StructType(schema.fields).add("step", IntegerType())).option("basePath", at)
        return rows.parquet(*[os.path.join(at, f"step={s}") for s in sorted(steps)]).drop("step")

    def next_step(self) -> int:
        last = self.ledger().agg(F.max("step")).first()[0]  # one scalar
        return 0 if last is None else last + 1

    def take(self, domains: DataFrame, crawl: Callable[[DataFrame], DataFrame], step: int) -> None:
        """Crawl ``domains(domain)`` and enter them."""
        start = time.time()
        at = os.path.join(self.path, "results", f"step={step}")
        crawl(domains).write.mode("overwrite").parquet(at)
        found = self.spark.read.parquet(at).groupBy("domain").agg(F.count("*").alias("pages"))
        pages = F.coalesce("pages", F.lit(0).cast("long"))
        # the step's time is shared by its domains
        seconds = (time.time() - start) / max(domains.count(), 1)
        rows = domains.join(found, "domain", "left").select(
            "domain", F.when(pages > 0, "completed").otherwise("failed").alias("status"), pages.alias("pages"), F.lit(seconds).alias("seconds")
        )
        rows.write.mode("overwrite").parquet(os.path.join(self.path, "ledger", f"step={step}"))


def process_queue(queue: DataFrame, crawl: Callable[[DataFrame], DataFrame], path: str, per_step: int = 100) -> QueueRun:
    """Crawl what of ``queue(pos, domain)`` the ledger below ``path`` does not have as completed, in the queue's order.

    ``crawl`` takes a frame of domains and returns result rows with a ``domain``; a domain that fails this time is not
    tried again in this run."""
    run = QueueRun(queue.sparkSession, path)
    left = written(remaining(queue, run.completed()), "queue")
    done = None
    while True:
        open_ = left if done is None else left.join(done, "domain", "left_anti")
        domains = written(open_.orderBy("pos").limit(per_step).select("domain"), "step")
        if domains.limit(1).count() == 0:
            return run
        run.take(domains, crawl, run.next_step())
        done = domains if done is None else written(done.unionByName(domains), "done")
