"""Queue file semantics: missing file, comments/blank lines, adds and listing."""

import os
import tempfile

from sitelens.sources import queue as QU


def test_missing_queue_file_is_empty(spark):
    assert QU.load_queue(spark, os.path.join(tempfile.mkdtemp(), "nope.txt")).count() == 0


def test_load_add_list(spark):
    d = tempfile.mkdtemp()
    path = os.path.join(d, "crawl_queue.txt")
    with open(path, "w") as f:
        f.write("# Crawl queue - domains to process\n# Format: domain\n  a.com \n\nb.com\n# note\nc.com\n")
    q = QU.load_queue(spark, path)
    assert [(r.pos, r.domain) for r in q.orderBy("pos").collect()] == [(1, "a.com"), (2, "b.com"), (3, "c.com")]
    new = spark.createDataFrame([(1, " d.com"), (2, "b.com"), (3, ""), (4, "d.com"), (5, "e.com ")], "pos long, domain string")
    q2 = QU.add_to_queue(q, new)
    assert [r.domain for r in q2.orderBy("pos").collect()] == ["a.com", "b.com", "c.com", "d.com", "e.com"]
    done = spark.createDataFrame([("b.com",)], "domain string")
    assert [r.domain for r in QU.remaining(q2, done).orderBy("pos").collect()] == ["a.com", "c.com", "d.com", "e.com"]
    assert [(r.ordinal, r.domain) for r in QU.listing(QU.remaining(q2, done)).orderBy("ordinal").collect()] == [
        (1, "a.com"), (2, "c.com"), (3, "d.com"), (4, "e.com")]


def test_batch_rollup_and_slowest(spark):
    rows = [(f"d{i}.com", float(i), i % 4 != 0) for i in range(1, 10)]
    out = spark.createDataFrame(rows, "domain string, seconds double, success boolean")
    r = QU.batch_rollup(out).first()
    assert (r.completed, r.failed, r.min_seconds, r.max_seconds) == (7, 2, 1.0, 9.0)
    assert [x.domain for x in QU.slowest(out).collect()] == ["d9.com", "d7.com", "d6.com", "d5.com", "d3.com"]
    assert QU.slowest(out.limit(4)).count() == 0  # five or fewer completed: nothing shown
