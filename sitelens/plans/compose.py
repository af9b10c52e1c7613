"""Pages composed from the driver's relational tables, for round-trip checks.

The driver's ``pages`` lack images, forms, media, JSON-LD, file links, social
links, Open Graph tags, headers and challenge pages. These builders write such
markup from ``part`` and ``customer`` columns (plain ``concat`` expressions,
so the page count grows with the tables), and the oracle SQL derives the
expected facts straight from the same columns — it never re-runs our regexes.
Decoys inside scripts and comments check that masked markup is ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.sources.pages import conform_pages, dealt, read_table

SHOP = "https://www.shop.example.com"

# File links written into part pages: (suffix, expected type). ".docx" is typed
# "doc" and ".tar.gz" "tar" (first listed extension contained in the href).
FILE_SAMPLES = [
    (".pdf", "pdf"), (".docx", "doc"), (".xlsx", "xls"), (".tar.gz", "tar"), (".PDF", "pdf"),
    (".csv", "csv"), (".html", None), (".json", "json"), (".pptx", "ppt"), (".zip", "zip"),
]
# Social links written into part pages: (host, expected platforms in order).
SOCIAL_SAMPLES = [
    ("facebook.com", ["facebook"]), ("twitter.com", ["twitter"]), ("x.com", ["twitter"]),
    ("www.instagram.com", ["instagram"]), ("linkedin.com", ["linkedin"]), ("netflix.com", ["twitter"]),
    ("github.com", ["github"]), ("example.org", []), ("reddit.com", ["reddit"]), ("youtube.com", ["youtube"]),
]


def _pick(k: Column, values: list[str]) -> Column:
    arr = F.array(*[F.lit(v) for v in values])
    return F.element_at(arr, (k % len(values) + 1).cast("int"))


def part_pages(spark, sf_dir: str) -> DataFrame:
    p = dealt(read_table(spark, sf_dir, "part"), "p_partkey")
    k = F.col("p_partkey")
    ks = k.cast("string")
    name, brand, typ, size = F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.col("p_size").cast("string")
    even, m3, m5 = (k % 2 == 0), (k % 3), (k % 5)
    opt = lambda cond, *parts: F.when(cond, F.concat(*parts)).otherwise(F.lit(""))
    file_suffix = _pick(k, [s for s, _ in FILE_SAMPLES])
    social_host = _pick(k, [h for h, _ in SOCIAL_SAMPLES])
    html = F.concat(
        F.lit('<!DOCTYPE html><html lang="en"><head><title>'), name, F.lit("</title>"),
        F.lit('<meta name="description" content="'), typ, F.lit('">'),
        F.lit('<meta property="og:title" content="'), name, F.lit('"><meta property="og:type" content="product">'),
        F.lit('<meta name="twitter:card" content="'), brand, F.lit('">'),
        opt(even, F.lit('<meta name="viewport" content="width=device-width">')),
        F.lit('<link rel="canonical" href="https://shop.example.com/p/'), ks, F.lit('">'),
        F.lit('<link rel="stylesheet" href="/css/site.css">'),
        opt(m3 == 0, F.lit('<script src="/js/jquery.min.js"></script>')),
        F.lit('<script type="application/ld+json">{"@type": "Product", "sku": '), ks, F.lit(', "name": "'), name, F.lit('"}</script>'),
        opt(k % 7 == 0, F.lit('<script type="application/ld+json">{broken</script>')),
        F.lit("<script>var api=\"/api/v1/items/"), ks, F.lit("\"; var tpl='<img src=\"decoy.png\">';</script>"),
        F.lit("</head><body><!-- <img src=\"commented.png\"> see https://cdn.shop.example.com/c/"), ks, F.lit(".js -->"),
        F.lit("<h1>"), name, F.lit("</h1><h2>"), brand, F.lit("</h2>"),
        F.lit('<img src="img/'), ks, F.lit('.png" alt="'), F.when(even, name).otherwise(F.lit("")), F.lit('" width="'), size, F.lit('">'),
        opt(m3 == 1, F.lit('<img src="../shared/logo.png" title="logo">')),
        F.lit('<a href="../docs/'), ks, file_suffix, F.lit('">Spec <b>sheet</b></a>'),
        F.lit('<a href="https://'), social_host, F.lit("/"), brand, F.lit('">Follow</a>'),
        opt(m5 == 0, F.lit('<iframe src="https://www.youtube.com/embed/'), ks, F.lit('"></iframe>')),
        opt(m5 == 1, F.lit('<video src="/media/'), ks, F.lit('.mp4"></video>')),
        opt(m5 == 2, F.lit('<iframe src="https://player.vimeo.com/video/'), ks, F.lit('"></iframe>')),
        opt(m5 == 3, F.lit('<iframe src="https://maps.example.net/'), ks, F.lit('"></iframe>')),
        F.lit('<form action="/cart/add/'), ks, F.lit('"'), opt(~even, F.lit(' method="post"')), F.lit(">"),
        F.lit('<input type="hidden" name="sku" value="'), ks, F.lit('"><input name="qty" required>'),
        F.lit('<select name="size" id="size'), ks, F.lit('"></select><textarea name="note"></textarea>'),
        F.lit('<button type="submit">Add</button></form>'),
        opt(k % 4 == 0, F.lit('<form action="/search"><input type="search" name="q"></form>')),
        F.lit("</body></html>"),
    )
    headers = F.when(
        m5 == 0,
        F.create_map(F.lit("Server"), F.lit("nginx/1.21.0"), F.lit("X-Powered-By"), F.lit("PHP/8.1")),
    ).otherwise(F.create_map(F.lit("Server"), F.when(even, F.lit("Apache/2.4")).otherwise(F.lit("gunicorn"))))
    return conform_pages(
        p.select(
            k.alias("page_id"),
            F.concat(F.lit(SHOP + "/p/"), ks, F.lit("/index.html")).alias("url"),
            html.alias("html"),
            headers.alias("headers"),
            F.lit(200).alias("status_code"),
            F.lit("text/html; charset=utf-8").alias("content_type"),
        )
    )


# Challenge-page bodies by customer key (c % 4) and status by market segment.
SEGMENT_STATUS = {"BUILDING": 403, "AUTOMOBILE": 503, "MACHINERY": 200, "HOUSEHOLD": 200, "FURNITURE": 404}


def customer_pages(spark, sf_dir: str) -> DataFrame:
    c = dealt(read_table(spark, sf_dir, "customer"), "c_custkey")
    k = F.col("c_custkey")
    ks = k.cast("string")
    status = F.lit(None).cast("int")
    for seg, code in SEGMENT_STATUS.items():
        status = F.when(F.col("c_mktsegment") == seg, F.lit(code)).otherwise(status)
    body = (
        F.when(k % 4 == 0, F.concat(F.lit('<div class="g-recaptcha" data-sitekey="sk'), ks, F.lit('"></div>')))
        .when(k % 4 == 1, F.concat(F.lit("<p>Checking your browser before accessing.</p><p>Cloudflare Ray ID: "), ks, F.lit("</p>")))
        .when(k % 4 == 2, F.concat(F.lit('<div class="h-captcha" data-sitekey="hk'), ks, F.lit('"></div><script src="https://hcaptcha.com/1/api.js"></script>')))
        .otherwise(F.lit("<p>Please solve the captcha.</p>"))
    )
    html = F.concat(F.lit("<html><head><title>"), F.col("c_name"), F.lit("</title></head><body>"), body, F.lit("</body></html>"))
    return conform_pages(
        c.select(
            k.alias("page_id"),
            F.concat(F.lit("https://accounts.example.com/c/"), ks).alias("url"),
            html.alias("html"),
            status.alias("status_code"),
            F.lit("text/html").alias("content_type"),
            F.create_map(
                F.lit("Set-Cookie"),
                F.concat(F.lit("sid="), ks, F.lit("; Path=/; Expires=Wed, 21 Oct 2026 07:28:00 GMT, seg="),
                         F.col("c_mktsegment"), F.lit("; HttpOnly, sid="), ks, F.lit("b")),
            ).alias("headers"),
        )
    )


# ---- fetch log derived from ``events`` ------------------------------------------
# event_type → (status, content type); "error" events become failed fetches.
EVENT_FETCH = {
    "view": (200, "text/html; charset=utf-8"),
    "click": (200, "text/html"),
    "signup": (404, "text/html"),
    "purchase": (500, "application/json"),
}
ERROR_TYPES = ["ConnectionError", "Timeout", "TooManyRedirects"]


def event_fetches(spark, sf_dir: str) -> DataFrame:
    """One fetch attempt per event: the user is the page, the event the attempt."""
    return fetches_from_events(read_table(spark, sf_dir, "events"))


def fetches_from_events(e: DataFrame) -> DataFrame:
    u = F.col("user_id")
    k = F.get_json_object("props", "$.k").cast("bigint")
    site = F.concat(F.lit("site"), (u % 5).cast("string"), F.lit(".example.com"))
    url = F.concat(F.lit("https://"), site, F.lit("/u/"), u.cast("string"))
    status = F.lit(None).cast("int")
    ctype = F.lit(None).cast("string")
    for et, (code, ct) in EVENT_FETCH.items():
        status = F.when(F.col("event_type") == et, F.lit(code)).otherwise(status)
        ctype = F.when(F.col("event_type") == et, F.lit(ct)).otherwise(ctype)
    is_err = F.col("event_type") == "error"
    err_type = F.when(is_err, F.element_at(F.array(*[F.lit(x) for x in ERROR_TYPES]), (k % 3 + 1).cast("int")))
    hop = F.concat(F.lit("http://"), site, F.lit("/u/"), u.cast("string"))
    redirects = (
        F.when(F.col("event_type") == "purchase", F.array(hop))
        .when((F.col("event_type") == "click") & (k % 10 == 0), F.array(hop, F.concat(hop, F.lit("/"))))
        .otherwise(F.array().cast("array<string>"))
    )
    return e.select(
        "event_id",
        url.alias("url"),
        site.alias("site"),
        F.when(~is_err, status).alias("status_code"),
        F.when(~is_err, ctype).alias("content_type"),
        F.when(~is_err, (k * 37 + 100)).cast("bigint").alias("size"),
        (F.col("event_id") % 4).cast("int").alias("depth"),
        F.when(~is_err, F.col("value") / 100.0).alias("response_time"),
        F.col("ts"),
        F.when(is_err, F.concat(F.lit("failed: "), k.cast("string"))).alias("error"),
        err_type.alias("error_type"),
        redirects.alias("redirects"),
    )


def tree_pages(spark, sf_dir: str) -> DataFrame:
    """A tree of pages over ``part``: with a fan-out f above the cube root of the pages, page k links to pages f*k+1 to
    f*k+f (relative hrefs, every second one through ``./``) and back to the root, so that three steps from the root
    reach every part."""
    p = dealt(read_table(spark, sf_dir, "part"), "p_partkey")
    n = p.count()  # part keys are 0 to n-1
    fan = int(n ** (1 / 3) + 1e-6) + 2
    k = F.col("p_partkey")
    children = F.filter(F.sequence(fan * k + 1, fan * k + fan), lambda c: c < n)
    link = lambda c: F.concat(
        F.lit('<a href="'), F.when(c % 2 == 0, F.lit("./../")).otherwise(F.lit("../")), c.cast("string"), F.lit('/index.html">next</a>')
    )
    html = F.concat(
        F.lit("<html><head><title>"), F.col("p_name"), F.lit("</title></head><body>"), F.array_join(F.transform(children, link), ""),
        F.lit('<a href="/t/0/index.html">home</a><a href="https://elsewhere.example.org/">out</a></body></html>'),
    )
    return conform_pages(
        p.select(k.alias("page_id"), F.concat(F.lit(SHOP + "/t/"), k.cast("string"), F.lit("/index.html")).alias("url"),
                 html.alias("html"), F.lit("text/html").alias("content_type"), F.lit(200).alias("status_code"))
    )
