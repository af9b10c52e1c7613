"""One small page through every extractor; expected values are worked out by hand."""

from pyspark.sql import functions as F

from sitelens.operators import challenge as C
from sitelens.operators import extract as X
from sitelens.operators import keywords as K
from sitelens.operators.seo import seo


def test_metadata(sample_pages):
    m = X.metadata(sample_pages).first()
    assert m.title == m.seo_title == "Korn & Kruste"
    assert (m.description, m.keywords) == ("Brot aus dem Steinofen", "brot, ofen, mehl")
    assert m.open_graph == {} and m.twitter == {}
    assert (m.canonical, m.language) == ("/start", "de")
    assert set(m.meta) == {"description", "keywords"}


def test_headings(sample_pages):
    assert [(r.level, r.text) for r in X.headings(sample_pages).collect()] == [("h1", "Backstube"), ("h2", "Heute")]


def test_emails_and_phones(sample_pages):
    assert [r.email for r in X.emails(sample_pages).collect()] == ["ofen@kruste.example"]
    assert [(r.pattern, r.phone) for r in X.phones(sample_pages).collect()] == [(4, "030.555.0199")]


def test_social(sample_pages):
    got = [(r.platform, r.link) for r in X.social_links(sample_pages).collect()]
    assert got == [("instagram", "https://www.instagram.com/kruste")]


def test_forms(sample_pages):
    f = X.forms(sample_pages).first()
    assert (f.action, f.method) == ("/korb", "GET")
    fields = [(x.type, x.name, x.id, x.required) for x in f.fields]
    assert fields == [("select", "sorte", "", False), ("textarea", "notiz", "n1", True)]


def test_images(sample_pages):
    got = [(i.src, i.alt, i.title, i.width, i.height) for i in X.images(sample_pages).orderBy("seq").collect()]
    assert got == [("https://kruste.example/laden/brot.jpg", "", "", "", ""), ("https://kruste.example/laib.png", "Laib", "", "40", "")]


def test_files(sample_pages):
    assert [(r.file_type, r.file_path) for r in X.files(sample_pages).collect()] == [("pdf", "https://kruste.example/laden/preise.pdf")]


def test_nothing_else(sample_pages):
    for fn in (X.videos, X.json_ld, X.api_endpoints, X.technologies):
        assert fn(sample_pages).count() == 0


def test_links_and_endpoints(sample_pages):
    links = X.links(sample_pages).orderBy("ord").collect()
    assert [(r.anchor_text, r.link_type) for r in links] == [("", "external"), ("Bilder", "external"), ("Preise", "external")]
    e = X.endpoints(sample_pages)
    assert sorted(r.endpoint for r in e.where("in_scope").collect()) == [
        "https://kruste.example/korb", "https://kruste.example/laden/brot.jpg", "https://kruste.example/laden/preise.pdf",
        "https://kruste.example/laib.png", "https://kruste.example/start",
    ]
    assert [r.endpoint for r in e.where("not in_scope").collect()] == ["https://www.instagram.com/kruste"]


def test_keywords_glue_across_tags(spark):
    from conftest import pages_of

    p = pages_of(spark, [(1, "https://kruste.example", "<p>Mehl Mehl Ofen</p><p>Teig xyz</p>")])
    rows = K.page_top_keywords(p).orderBy("rank").collect()
    assert [(r.keyword, r.frequency) for r in rows] == [("mehl", 2), ("ofenteig", 1), ("xyz", 1)]


def test_seo(sample_pages):
    s = seo(sample_pages).first()
    assert (s.title_length, s.title_optimal, s.description_length, s.description_optimal) == (13, False, 22, False)
    assert (s.h1_count, s.h1_optimal) == (1, True)
    assert (s.images_total, s.images_without_alt, s.alt_percentage) == (2, 1, 50.0)
    assert s.https is True and s.mobile_friendly is False
    assert (s.links_total, s.links_internal, s.links_external) == (2, 0, 2)
    assert s.page_bytes == len(sample_pages.first().html.encode())


def test_mock_response_headers(spark):
    from sitelens.sources.pages import conform_pages

    df = spark.createDataFrame(
        [(2, "https://example.com", "<html><head><title>Test</title></head><body><p>Test content</p></body></html>",
          {"Content-Type": "text/html; charset=utf-8", "Server": "nginx/1.21.0"}, 200, 0.5)],
        "page_id long, url string, html string, headers map<string,string>, status_code int, elapsed double",
    )
    p = conform_pages(df, site="example.com")
    assert [r.technology for r in X.technologies(p).collect()] == ["Nginx"]
    assert C.classify(p).first().is_challenge is False
    assert seo(p).first().response_time_optimal is True
    from sitelens.operators.fetch import content_type_base
    assert spark.range(1).select(content_type_base(F.lit("text/html; charset=utf-8"))).first()[0] == "text/html"
