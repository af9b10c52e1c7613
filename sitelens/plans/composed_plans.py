"""Round-trip queries: markup composed from table columns, extracted by Spark,
checked against expectations the oracle reads straight from the columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelens.operators import challenge as C
from sitelens.operators import extract as X
from sitelens.operators.seo import seo
from sitelens.plans.compose import FILE_SAMPLES, SHOP, SOCIAL_SAMPLES, customer_pages, part_pages
from sitelens.plans.registry import register

BASE = SHOP + "/p/"

IMAGES_SQL = f"""
SELECT p_partkey AS page_id, '{BASE}' || p_partkey || '/img/' || p_partkey || '.png' AS src,
       CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END AS alt, '' AS title, CAST(p_size AS VARCHAR) AS width, '' AS height
FROM part
UNION ALL
SELECT p_partkey, '{BASE}shared/logo.png', '', 'logo', '', '' FROM part WHERE p_partkey % 3 = 1
"""


@register("images", IMAGES_SQL)
def images(spark, sf_dir):
    """E15 + E24: img rows with resolved src (decoys in script/comment ignored)."""
    return X.images(part_pages(spark, sf_dir)).select("page_id", "src", "alt", "title", "width", "height")


IMG_SEO_SQL = """
SELECT p_partkey AS page_id, CAST(1 + CASE WHEN p_partkey % 3 = 1 THEN 1 ELSE 0 END AS BIGINT) AS images_total,
       CAST(CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 1 END + CASE WHEN p_partkey % 3 = 1 THEN 1 ELSE 0 END AS BIGINT) AS images_without_alt,
       CAST(2 AS BIGINT) AS links_total, CAST(0 AS BIGINT) AS links_internal, p_partkey % 2 = 0 AS mobile_friendly
FROM part
"""


@register("seo_images_links", IMG_SEO_SQL)
def seo_images_links(spark, sf_dir):
    """Q4, Q8, Q9 on composed pages (alt missing or empty counts as without alt)."""
    s = seo(part_pages(spark, sf_dir))
    return s.select(
        "page_id", F.col("images_total").cast("bigint").alias("images_total"),
        F.col("images_without_alt").cast("bigint").alias("images_without_alt"),
        F.col("links_total").cast("bigint").alias("links_total"), F.col("links_internal").cast("bigint").alias("links_internal"),
        "mobile_friendly",
    )


FORMS_SQL = """
SELECT p_partkey AS page_id, 0 AS ord, '/cart/add/' || p_partkey AS action,
       CASE WHEN p_partkey % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, 4 AS n_fields FROM part
UNION ALL
SELECT p_partkey, 1, '/search', 'GET', 1 FROM part WHERE p_partkey % 4 = 0
"""


@register("forms", FORMS_SQL)
def forms(spark, sf_dir):
    """Forms with action, upper-cased method (default GET) and field count."""
    f = X.forms(part_pages(spark, sf_dir))
    return f.select("page_id", "ord", "action", "method", F.size("fields").alias("n_fields"))


FIELDS_SQL = """
SELECT p_partkey AS page_id, 0 AS form_ord, f.field_pos, f.type, f.name, f.id, f.required
FROM part, (VALUES (0, 'hidden', 'sku', false), (1, 'input', 'qty', true), (2, 'select', 'size', false), (3, 'textarea', 'note', false))
     AS v(field_pos, type, name, required),
     LATERAL (SELECT v.field_pos, v.type, v.name, CASE WHEN v.name = 'size' THEN 'size' || p_partkey ELSE '' END AS id, v.required) f
UNION ALL
SELECT p_partkey, 1, 0, 'search', 'q', '', false FROM part WHERE p_partkey % 4 = 0
"""


@register("form_fields", FIELDS_SQL)
def form_fields(spark, sf_dir):
    """E14 + J11: fields of each form in order; type defaults to the tag; buttons excluded."""
    ff = X.form_fields(X.forms(part_pages(spark, sf_dir)))
    return ff.select("page_id", "form_ord", "field_pos", "type", "name", "id", "required")


VIDEOS_SQL = """
SELECT p_partkey AS page_id,
       CASE p_partkey % 5 WHEN 0 THEN 'https://www.youtube.com/embed/' || p_partkey WHEN 1 THEN '/media/' || p_partkey || '.mp4'
            WHEN 2 THEN 'https://player.vimeo.com/video/' || p_partkey ELSE 'https://maps.example.net/' || p_partkey END AS src,
       CASE WHEN p_partkey % 5 = 1 THEN 'video' ELSE 'iframe' END AS type,
       CASE p_partkey % 5 WHEN 0 THEN 'youtube' WHEN 2 THEN 'vimeo' ELSE NULL END AS platform
FROM part WHERE p_partkey % 5 < 4
"""


@register("videos", VIDEOS_SQL)
def videos(spark, sf_dir):
    """Video and every iframe; platform only for YouTube/Vimeo iframes."""
    return X.videos(part_pages(spark, sf_dir)).select("page_id", "src", "type", "platform")


JSONLD_SQL = "SELECT p_partkey AS page_id, 'Product' AS ld_type, p_partkey AS sku FROM part"


@register("json_ld", JSONLD_SQL)
def json_ld(spark, sf_dir):
    """JSON-LD blocks that parse (the broken block on every 7th page is dropped)."""
    j = X.json_ld(part_pages(spark, sf_dir))
    return j.select(
        "page_id",
        F.try_variant_get("data", "$['@type']", "string").alias("ld_type"),
        F.try_variant_get("data", "$.sku", "bigint").alias("sku"),
    )


def _files_sql() -> str:
    cases = " ".join(f"WHEN {i} THEN '{s}'" for i, (s, _) in enumerate(FILE_SAMPLES))
    types = " ".join(f"WHEN {i} THEN {repr(t) if t else 'NULL'}" for i, (_, t) in enumerate(FILE_SAMPLES))
    return f"""
SELECT page_id, file_type, file_path FROM (
  SELECT p_partkey AS page_id, CASE p_partkey % {len(FILE_SAMPLES)} {types} END AS file_type,
         '{BASE}docs/' || p_partkey || CASE p_partkey % {len(FILE_SAMPLES)} {cases} END AS file_path FROM part)
WHERE file_type IS NOT NULL
"""


@register("files", _files_sql())
def files(spark, sf_dir):
    """E18 + J9: file links typed by the first listed extension found (".docx" → doc)."""
    return X.files(part_pages(spark, sf_dir)).select("page_id", "file_type", "file_path")


def _social_sql() -> str:
    rows = []
    for i, (host, plats) in enumerate(SOCIAL_SAMPLES):
        for p in plats:
            rows.append(f"SELECT p_partkey AS page_id, '{p}' AS platform, 'https://{host}/' || p_brand AS link FROM part WHERE p_partkey % {len(SOCIAL_SAMPLES)} = {i}")
    return " UNION ALL ".join(rows)


@register("social_links", _social_sql())
def social_links(spark, sf_dir):
    """E12 + J8: resolved anchors matched to platforms (netflix.com counts as twitter)."""
    return X.social_links(part_pages(spark, sf_dir)).select("page_id", "platform", "link")


def _social_site_sql() -> str:
    return f"""
SELECT 'shop.example.com' AS site, platform, count(DISTINCT link) AS links FROM ({_social_sql()}) GROUP BY platform
"""


@register("social_by_platform", _social_site_sql())
def social_by_platform(spark, sf_dir):
    """Distinct social links per site and platform."""
    s = X.social_links(part_pages(spark, sf_dir))
    return s.groupBy("site", "platform").agg(F.count_distinct("link").alias("links"))


META_SQL = """
SELECT p_partkey AS page_id, p_name AS title, p_type AS description, '' AS keywords,
       p_name AS og_title, 'product' AS og_type, p_brand AS twitter_card,
       'https://shop.example.com/p/' || p_partkey AS canonical, 'en' AS language,
       CAST(4 + CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS meta_entries
FROM part
"""


@register("open_graph_twitter", META_SQL)
def open_graph_twitter(spark, sf_dir):
    """Meta map, OG and Twitter maps, canonical and language."""
    m = X.metadata(part_pages(spark, sf_dir))
    return m.select(
        "page_id", "title", "description", "keywords",
        F.col("open_graph")["og:title"].alias("og_title"), F.col("open_graph")["og:type"].alias("og_type"),
        F.col("twitter")["twitter:card"].alias("twitter_card"), "canonical", "language",
        F.size("meta").alias("meta_entries"),
    )


TECH_SQL = """
SELECT p_partkey AS page_id, 'jQuery' AS technology FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey, 'Nginx' FROM part WHERE p_partkey % 5 = 0
UNION ALL SELECT p_partkey, 'PHP' FROM part WHERE p_partkey % 5 = 0
UNION ALL SELECT p_partkey, 'Apache' FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 2 = 0
"""


@register("technologies_headers", TECH_SQL)
def technologies_headers(spark, sf_dir):
    """E27 + E28 + A10: technologies from the HTML and the response headers."""
    return X.technologies(part_pages(spark, sf_dir)).select("page_id", "technology")


TECH_ALL_SQL = f"SELECT DISTINCT 'shop.example.com' AS site, technology FROM ({TECH_SQL})"


@register("technologies_site", TECH_ALL_SQL)
def technologies_site(spark, sf_dir):
    """The union of technologies seen on a site."""
    return X.technologies(part_pages(spark, sf_dir)).select("site", "technology").distinct()


CHALLENGE_SQL = """
WITH c AS (SELECT c_custkey AS k, CASE c_mktsegment WHEN 'BUILDING' THEN 403 WHEN 'AUTOMOBILE' THEN 503
             WHEN 'FURNITURE' THEN 404 ELSE 200 END AS status_code FROM customer),
d AS (SELECT k, status_code,
        CASE WHEN status_code = 200 THEN k % 4 IN (0, 2) WHEN status_code IN (403, 503) THEN k % 4 <> 3 ELSE false END AS is_challenge
      FROM c)
SELECT k AS page_id, status_code, is_challenge,
       CASE WHEN NOT is_challenge THEN NULL WHEN k % 4 = 0 THEN 'recaptcha' WHEN k % 4 = 2 THEN 'hcaptcha' ELSE 'cloudflare' END AS provider,
       CASE WHEN NOT is_challenge THEN NULL WHEN k % 4 = 0 THEN 'sk' || k WHEN k % 4 = 2 THEN 'hk' || k ELSE NULL END AS sitekey
FROM d
"""


@register("challenge_pages", CHALLENGE_SQL)
def challenge_pages(spark, sf_dir):
    """Challenge detection by status, provider order, site key."""
    c = C.classify(customer_pages(spark, sf_dir))
    return c.select("page_id", "status_code", "is_challenge", "provider", "sitekey")


KEPT_SQL = f"SELECT page_id, status_code FROM ({CHALLENGE_SQL}) WHERE NOT is_challenge"


@register("challenge_dropped", KEPT_SQL)
def challenge_dropped(spark, sf_dir):
    """F16: pages that survive challenge filtering."""
    return C.drop_challenges(customer_pages(spark, sf_dir)).select("page_id", "status_code")


COOKIES_SQL = """
SELECT c_custkey AS page_id, 'sid' AS name, c_custkey || 'b' AS value FROM customer
UNION ALL SELECT c_custkey, 'seg', c_mktsegment FROM customer
"""


@register("cookies", COOKIES_SQL)
def cookies(spark, sf_dir):
    """cookies map from Set-Cookie headers (Expires commas kept, last value wins)."""
    from sitelens.operators.fetch import cookies as cookie_map

    p = customer_pages(spark, sf_dir)
    return p.select("page_id", F.explode(cookie_map(F.col("headers"))).alias("name", "value"))
