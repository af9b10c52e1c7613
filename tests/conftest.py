import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from sitelens.session import build_session

    s = build_session(master="local[4]", shuffle_partitions=8, app="sitelens-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SAMPLE_HTML = """<!DOCTYPE html><html lang="de"><head><title>Korn &amp; Kruste</title>
<meta name="description" content="Brot aus dem Steinofen"><meta name="keywords" content="brot, ofen, mehl">
<link rel="canonical" href="/start"></head><body><h1>Backstube</h1><h2>Heute</h2>
<p>Bestellung an ofen@kruste.example oder 030.555.0199 anrufen.</p>
<a href="https://www.instagram.com/kruste">Bilder</a> <a href="preise.pdf"><b>Preise</b></a>
<img src="brot.jpg"><img src="/laib.png" alt="Laib" width="40">
<form action="/korb"><select name="sorte"></select><textarea name="notiz" id="n1" required></textarea><button>Los</button></form>
</body></html>"""


@pytest.fixture(scope="session")
def sample_pages(spark):
    from sitelens.sources.pages import conform_pages

    df = spark.createDataFrame([(1, "https://kruste.example/laden/", SAMPLE_HTML)], "page_id long, url string, html string")
    return conform_pages(df, site="kruste.example")


def pages_of(spark, rows, site="example.com", **extra):
    """rows: list of (page_id, url, html)."""
    from sitelens.sources.pages import conform_pages

    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return conform_pages(df, site=site)
