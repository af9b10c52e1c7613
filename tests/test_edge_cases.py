"""Edge cases from cited behaviour of the analysed tool."""

from pyspark.sql import functions as F

from conftest import pages_of
from sitelens.operators import challenge as C
from sitelens.operators import extract as X
from sitelens.operators import keywords as K


def one(spark, html, url="https://example.com/"):
    return pages_of(spark, [(1, url, html)])


def test_meta_title_overrides_title(spark):
    m = X.metadata(one(spark, '<title>a</title><meta name="title" content="b">')).first()
    assert (m.title, m.seo_title) == ("b", "a")


def test_empty_name_meta_goes_to_og_only(spark):
    m = X.metadata(one(spark, '<meta name="" property="og:x" content="1">')).first()
    assert m.meta == {} and m.open_graph == {"og:x": "1"}


def test_keywords_name_is_case_sensitive(spark):
    assert X.metadata(one(spark, '<meta name="Keywords" content="k">')).first().keywords == ""


def test_file_types_first_listed_extension(spark):
    html = '<a href="x.docx">a</a><a href="y.xlsx">b</a><a href="z.tar.gz">c</a>'
    assert [r.file_type for r in X.files(one(spark, html)).orderBy("seq").collect()] == ["doc", "xls", "tar"]


def test_netflix_counts_as_twitter(spark):
    assert [r.platform for r in X.social_links(one(spark, '<a href="https://netflix.com">n</a>')).collect()] == ["twitter"]


def test_img_without_src_and_input_without_type(spark):
    p = one(spark, '<img><form><input name="q"></form>')
    assert X.images(p).first().src == "https://example.com/"
    assert X.forms(p).first().fields[0].type == "input"


def test_foreign_iframe_is_video_without_platform(spark):
    v = X.videos(one(spark, '<iframe src="https://maps.example.net/x"></iframe>')).first()
    assert (v.type, v.platform) == ("iframe", None)


def test_www_comment_url_resolves_relative(spark):
    e = X.endpoints(one(spark, "<!-- see www.a.com/b -->", url="https://example.com"))
    assert [r.endpoint for r in e.where("in_scope").collect()] == ["https://example.com/www.a.com/b"]


def test_mailto_and_javascript_are_external(spark):
    e = X.endpoints(one(spark, '<a href="mailto:x@y.z">m</a><a href="javascript:void(0)">j</a>'))
    assert e.where("in_scope").count() == 0 and e.count() == 2


def test_challenge_rules(spark):
    def chal(status, body):
        df = spark.createDataFrame([(status, body)], "status_code int, html string")
        return C.classify(df).first().is_challenge

    assert chal(403, "captcha") is False
    assert chal(403, "recaptcha") is True       # recaptcha + captcha
    assert chal(200, "recaptcha") is False      # needs g-recaptcha
    assert chal(404, "g-recaptcha captcha") is False
    assert chal(500, "g-recaptcha captcha") is False


def test_tokens_glue_across_tags(spark):
    rows = K.page_keywords(one(spark, "<title>Example Domain</title><body>body")).collect()
    assert "domainbody" in {r.keyword for r in rows}


def test_keyword_filters(spark):
    kept = {r.keyword for r in K.page_keywords(one(spark, "rhythms aaaa 2024 naïve ab 60vw eee")).collect()}
    assert kept == {"60vw", "eee"}


def test_script_and_comment_markup_is_masked(spark):
    p = one(spark, '<script>var s="<img src=a.png>";</script><!-- <img src=b.png> --><img src="c.png">')
    assert [r.src for r in X.images(p).collect()] == ["https://example.com/c.png"]


def test_entities_and_unicode_trim(spark):
    t = X.metadata(one(spark, "<title>  A &amp; B&nbsp;</title>")).first().title
    assert t == "A & B"


def test_quoted_gt_and_unquoted_attrs(spark):
    p = one(spark, """<a href="/x?a>b" title='q'>x</a><img src=plain.png alt=y>""")
    assert [r.target_url for r in X.links(p).collect()] == ["/x?a>b"]
    i = X.images(p).first()
    assert (i.src, i.alt) == ("https://example.com/plain.png", "y")


def test_huge_tags_do_not_overflow_the_regex_stack(spark):
    # Thousands of attributes in one tag used to recurse once per attribute in
    # java.util.regex and kill the executor; the bounded possessive form must not.
    plain = "<div " + "a " * 20000 + ">x</div>"
    quoted = "<div " + 'a="1" ' * 5000 + ">y</div>"
    p = one(spark, plain + quoted + "<img src=\"a.png\" alt='q>r'><a href=\"/q\">q</a>")
    assert X.images(p).first().alt == "q>r"
    assert X.links(p).count() == 1
    assert X.page_text(p).first().text == "xyq"


def test_numeric_character_references(spark):
    from sitelens.functions.text import decode_entities

    cases = {"&#8217;s": "’s", "&#x2019;": "’", "&#X1F600;": "😀", "&#128;": "€", "&#233;t&#xE9;": "été",
             "a&amp;#39;b": "a&#39;b", "&lt;&#60;&amp;": "<<&", "&#160;": "\xa0"}
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", decode_entities(F.col("s")).alias("d"))
    assert {r.s: r.d for r in df.collect()} == cases


def test_character_references_equal_the_standard_library(spark):
    from html import unescape
    from html.entities import html5

    from sitelens.functions.text import decode_entities

    cases = ["&eacute; &uuml; &rarr;&szlig;", "&#65 &lt &copy 2", "&#0000000065;", "&#38;lt;", "&amp;lt;", "&notit; &notin; &not", "&", "&&", "& ;",
             "&#;", "&#x;", "&#xZ;", "&#12345678901;", "&#xD800;", "&#1;", "&#127;", "&#129;", "&#xFDD0;", "&#x1FFFE;", "&nosuch;", "&AMP&amp", "x&y;z",
             "&acE;", "&#13;", "a&lt;b&gt;c", "&CounterClockwiseContourIntegral;", "&ampamp;", "&#x26;amp;", "&frac12x", "&#0;"]
    cases += [f"a&{k}b" for k in list(html5)[::7]] + [f"&#{n};{n}" for n in range(0, 300)] + [f"&#x{n:x}" for n in range(0, 70000, 997)]
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", decode_entities(F.col("s")).alias("d"))
    bad = [(r.s, r.d, unescape(r.s)) for r in df.collect() if r.d != unescape(r.s)]
    assert not bad, bad[:5]


def test_many_attributes_keep_their_values(spark):
    attrs = " ".join(f'data-{i}="v{i}"' for i in range(60))
    img = X.images(one(spark, f'<img {attrs} src="a>b.png" alt="x">')).first()
    assert (img.src, img.alt) == ("https://example.com/a>b.png", "x")


def test_large_pages_take_linear_time(spark):
    import time

    def seconds(n):
        page = "".join(f'<h2>h{i}</h2><a href="/{i}">t<b>{i}</b></a><form><input name=f{i}></form>' for i in range(n))
        p = one(spark, page).cache()
        p.count()
        t = time.time()
        assert X.links(p).where("anchor_text = concat('t', substring(target_url, 2))").count() == n
        assert X.headings(p).count() == n
        assert X.form_fields(X.forms(p)).count() == n
        return time.time() - t

    seconds(500)
    assert seconds(20_000) < 30


def test_cookies_from_set_cookie(spark):
    from sitelens.operators.fetch import cookies

    df = spark.createDataFrame(
        [({"Set-Cookie": "a=1; Expires=Wed, 21 Oct 2026 07:28:00 GMT, b=2; Path=/, a=3"},), ({"Server": "x"},), (None,)],
        "headers map<string,string>",
    )
    got = [r.c for r in df.select(cookies(F.col("headers")).alias("c")).collect()]
    assert got == [{"a": "3", "b": "2"}, {}, {}]
