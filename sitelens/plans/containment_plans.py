"""Queries over pages with nested and unclosed tags, composed from ``part`` columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.operators import extract as X
from sitelens.plans.compose import SHOP
from sitelens.plans.registry import register
from sitelens.sources.pages import conform_pages, dealt, read_table


def soup_pages(spark, sf_dir: str) -> DataFrame:
    """One page a part: nested anchors, anchors and headings without end tags, forms inside forms and one
    left open, end tags that close nothing, void and self-closed tags."""
    p = dealt(read_table(spark, sf_dir, "part"), "p_partkey")
    ks = F.col("p_partkey").cast("string")
    name, brand, typ, box = F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.col("p_type")
    many = (F.col("p_partkey") % 3 + 1).cast("int")  # unclosed items of a list
    item = F.concat(F.lit('<li><a href="/u/'), ks, F.lit('">'), brand, F.lit("<br><i>"), box, F.lit("</i>"))
    html = F.concat(
        F.lit("<html><body></b></form>"),
        F.lit('<a href="/o/'), ks, F.lit('">outer '), name, F.lit(' <a href="/i/'), ks, F.lit('">in '), brand, F.lit("</a> tail</a>"),
        F.lit("<ul>"), F.array_join(F.transform(F.sequence(F.lit(1), many), lambda _: item), ""), F.lit("</ul> not a link "),
        F.lit("<div><h2>"), typ, F.lit("</div> loose <h1>"), name, F.lit(" <span>"), brand, F.lit("</h1> after <h3/>"),
        F.lit("<h2>one "), box, F.lit("<h2>two "), box, F.lit("<h3>three</h3> more "),
        F.lit('<input name="alone"><form action="/out/'), ks, F.lit('"><p><input name="first">'),
        F.lit('<form action="/in/'), ks, F.lit('" method="post"><div><select name="size" id="s'), ks, F.lit('" required><option></select></form>'),
        F.lit('<textarea name="note"></textarea></form><input name="between">'),
        F.when(F.col("p_size") % 2 == 0, F.concat(F.lit('<section><form action="/open"><input type="search" name="q"></section><input name="late">'))).otherwise(F.lit("")),
        F.lit('<a href="/end/'), ks, F.lit('">the end'),
    )
    return conform_pages(
        p.select(F.col("p_partkey").alias("page_id"), F.concat(F.lit(SHOP + "/s/"), ks).alias("url"), html.alias("html"))
    )


LINKS_SQL = """
SELECT p_partkey AS page_id, v.ord::INTEGER AS ord, v.target_url, v.anchor_text FROM part, LATERAL (
  SELECT 0 AS ord, '/o/' || p_partkey AS target_url, 'outer ' || p_name || ' in ' || p_brand || ' tail' AS anchor_text
  UNION ALL SELECT 1, '/i/' || p_partkey, 'in ' || p_brand
  UNION ALL SELECT 1 + i, '/u/' || p_partkey, p_brand || p_type FROM range(1, p_partkey % 3 + 2) r(i)
  UNION ALL SELECT 3 + p_partkey % 3, '/end/' || p_partkey, 'the end') v
"""


@register("contained_links", LINKS_SQL)
def contained_links(spark, sf_dir):
    """An anchor holds all up to its end tag, other anchors included; one without ends with its parent or at the next."""
    return X.links(soup_pages(spark, sf_dir)).select("page_id", "ord", "target_url", "anchor_text")


HEADINGS_SQL = """
SELECT p_partkey AS page_id, v.level, v.ord::INTEGER AS ord, v.text FROM part, LATERAL (
  SELECT 'h1' AS level, 0 AS ord, p_name || ' ' || p_brand AS text
  UNION ALL SELECT 'h2', 0, p_type UNION ALL SELECT 'h2', 1, 'one ' || p_type UNION ALL SELECT 'h2', 2, 'two ' || p_type
  UNION ALL SELECT 'h3', 0, '' UNION ALL SELECT 'h3', 1, 'three') v
"""


@register("contained_headings", HEADINGS_SQL)
def contained_headings(spark, sf_dir):
    """Headings without end tags end with their parent, or at the next heading."""
    return X.headings(soup_pages(spark, sf_dir)).select("page_id", "level", "ord", "text")


FIELDS_SQL = """
SELECT p_partkey AS page_id, v.form_ord::INTEGER AS form_ord, v.action, v.method, v.field_pos::INTEGER AS field_pos, v.type, v.name, v.id, v.required
FROM part, LATERAL (
  SELECT 0 AS form_ord, '/out/' || p_partkey AS action, 'GET' AS method, 0 AS field_pos, 'input' AS type, 'first' AS name, '' AS id, false AS required
  UNION ALL SELECT 0, '/out/' || p_partkey, 'GET', 1, 'textarea', 'note', '', false
  UNION ALL SELECT 1, '/in/' || p_partkey, 'POST', 0, 'select', 'size', 's' || p_partkey, true
  UNION ALL SELECT 2, '/open', 'GET', 0, 'search', 'q', '', false WHERE p_size % 2 = 0) v
"""


@register("contained_fields", FIELDS_SQL)
def contained_fields(spark, sf_dir):
    """A field belongs to its innermost open form; outside of forms to none."""
    forms = X.forms(soup_pages(spark, sf_dir))
    named = forms.select("page_id", F.col("ord").alias("form_ord"), "action", "method", F.posexplode("fields").alias("field_pos", "fl"))
    return named.select("page_id", "form_ord", "action", "method", "field_pos", "fl.type", "fl.name", "fl.id", "fl.required")
