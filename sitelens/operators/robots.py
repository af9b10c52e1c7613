"""Robots rules.

``robots(site, body)`` holds one robots.txt per target domain (the file of the
target domain governs all its subdomains). A robots file is small and bounded
(crawlers cap it at a few hundred KiB), so each file is parsed inside its own
row: an ``aggregate`` fold over its lines implements the standard library's
``urllib.robotparser`` state machine —

* a line is blank only if it is empty before comment removal;
* ``allow``/``disallow`` lines count only after a ``user-agent`` line with no
  blank line in between;
* a new group starts at a ``user-agent`` line that follows a rule, or after a
  blank line that ends a group; groups without rules are dropped;
* the first group listing ``*`` is the default and is consulted last; other
  groups apply when one of their agent names occurs in the crawler's token;
* inside the chosen group the first rule (file order) whose path prefixes the
  URL path (or is ``*``) decides; an empty ``Disallow:`` allows; no match allows.

The result is one row per site with the governing rule list. URLs meet it with
a single equi-join on site, which Spark plans from the measured sizes (a hot site's
URLs are split), and a per-row first-match over that list. Paths on both sides
are compared with their percent-encoding normalised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions.lookups import USER_AGENTS
from sitelens.functions.text import let


def agent_token(agent: str) -> str:
    return agent.split("/")[0].lower()


def _classify(raw: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(raw, "#.*$", ""), r"^\s+|\s+$", "")
    field = F.lower(F.regexp_replace(F.regexp_extract(text, "^([^:]*):", 1), r"^\s+|\s+$", ""))
    value = F.regexp_replace(F.regexp_extract(text, "^[^:]*:(.*)$", 1), r"^\s+|\s+$", "")
    kind = (
        F.when(raw == "", F.lit("blank"))
        .when(~text.contains(":"), F.lit("other"))
        .when(field == "user-agent", F.lit("ua"))
        .when(field == "allow", F.lit("allow"))
        .when(field == "disallow", F.lit("disallow"))
        .when(field.isin("crawl-delay", "request-rate"), F.lit("mark"))
        .otherwise(F.lit("other"))
    )
    return F.struct(kind.alias("kind"), value.alias("value"))


def parse(body: Column) -> Column:
    """Fold the lines of one robots.txt into its groups (agents and rules)."""
    lines = F.transform(F.split(F.coalesce(body, F.lit("")), r"\r\n|\r|\n"), _classify)
    init = F.struct(
        F.lit(0).alias("mode"), F.lit(0).alias("entry"),
        F.array().cast("array<struct<entry:int,agent:string>>").alias("agents"),
        F.array().cast("array<struct<entry:int,line:int,allow:boolean,path:string>>").alias("rules"),
    )

    def step(st: Column, ln: Column) -> Column:
        mode, entry, kind = st["mode"], st["entry"], ln["kind"]
        # a delay or rate makes a group too; it stands among the rules with a path that fits nothing
        is_rule = kind.isin("allow", "disallow", "mark")
        new_entry = (
            F.when((kind == "blank") & (mode != 0), entry + 1)
            .when((kind == "ua") & (mode == 2), entry + 1)
            .otherwise(entry)
        )
        new_mode = (
            F.when(kind == "blank", F.lit(0))
            .when(kind == "ua", F.lit(1))
            .when(is_rule & (mode != 0), F.lit(2))
            .otherwise(mode)
        )
        agents = F.when(
            kind == "ua", F.concat(st["agents"], F.array(F.struct(new_entry.alias("entry"), ln["value"].alias("agent"))))
        ).otherwise(st["agents"])
        rule = F.struct(
            entry.alias("entry"), F.size(st["rules"]).alias("line"),
            ((kind == "allow") | (ln["value"] == "")).alias("allow"),
            F.when(kind != "mark", normalise(ln["value"])).alias("path"),
        )
        rules = F.when(is_rule & (mode != 0), F.concat(st["rules"], F.array(rule))).otherwise(st["rules"])
        return F.struct(new_mode.alias("mode"), new_entry.alias("entry"), agents.alias("agents"), rules.alias("rules"))

    return F.aggregate(lines, init, step)


def governing_rules(parsed: Column, agent: str) -> Column:
    """The rule list (file order) of the one group that governs ``agent``. Every part is
    bound once, so the work grows with the file and not with its square."""
    token = agent_token(agent)

    def entries(agents: Column, test) -> Column:
        return F.array_distinct(F.transform(F.filter(agents, lambda a: test(a["agent"])), lambda a: a["entry"]))

    def choose(p: Column) -> Column:
        with_rules = F.array_distinct(F.transform(p["rules"], lambda r: r["entry"]))
        star = entries(p["agents"], lambda a: a == "*")
        named = entries(p["agents"], lambda a: F.instr(F.lit(token), F.lower(a)) > 0)
        specific = F.array_min(F.array_intersect(with_rules, F.array_except(named, star)))
        return F.coalesce(specific, F.array_min(F.array_intersect(with_rules, star)))

    return let(parsed, lambda p: let(choose(p), lambda chosen: F.filter(p["rules"], lambda r: r["entry"] == chosen)))


def site_rules(robots: DataFrame, agents: dict[str, str]) -> DataFrame:
    """(site, one rule list per agent, named by the keys of ``agents``): map-only, one parse per file."""
    lists = let(parse(F.col("body")), lambda p: F.struct(*[governing_rules(p, a).alias(name) for name, a in agents.items()]))
    return robots.select("site", lists.alias("_lists")).select("site", "_lists.*")


def normalise(path: Column) -> Column:
    """Percent-encoding of a path or URL tail as ``quote(unquote(...))`` writes it: every
    escape is read, then all but letters, digits and ``_.-~/`` is escaped; an empty query or fragment goes."""
    escaped = F.regexp_replace(F.replace(path, F.lit("+"), F.lit("%2B")), "%(?![0-9a-fA-F]{2})", "%25")
    plain = F.regexp_replace(F.regexp_replace(F.url_decode(escaped), "#$", ""), r"\?(?=#|$)", "")
    out = F.url_encode(plain)
    for old, new in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.when(path.rlike("[^a-zA-Z0-9_./~-]"), out).otherwise(path)


def url_path(url) -> Column:
    p = normalise(F.regexp_extract(url, r"(?s)^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*(.*)$", 1))
    return F.when(p == "", F.lit("/")).otherwise(p)


def decide(rules: Column, path: Column) -> Column:
    """First matching rule decides; an empty Disallow allows; no match allows."""
    hit = let(path, lambda p: F.try_element_at(F.filter(rules, lambda r: p.startswith(r["path"])), F.lit(1)))
    return F.when(hit.isNull(), F.lit(True)).otherwise(hit["allow"])


def can_fetch_as(urls: DataFrame, robots: DataFrame | None, agents: dict[str, str], respect_robots: bool = True) -> DataFrame:
    """Adds one decision column per agent (named by the keys of ``agents``) to ``urls(site, url, …)``:
    each robots file is parsed once and joined once. Without rules (or when robots are
    ignored) everything is allowed."""
    if robots is None or not respect_robots:
        return urls.withColumns({name: F.lit(True) for name in agents})
    rules = site_rules(robots, {f"_rules_{name}": a for name, a in agents.items()}).withColumnRenamed("site", "_rsite")
    j = urls.join(rules, urls["site"] == rules["_rsite"], "left").withColumn("_path", url_path(F.col("url")))
    for name in agents:
        held = F.col(f"_rules_{name}")
        j = j.withColumn(name, F.when(held.isNull(), F.lit(True)).otherwise(decide(held, F.col("_path"))))
    return j.drop("_rsite", "_path", *[f"_rules_{name}" for name in agents])


def can_fetch(urls: DataFrame, robots: DataFrame | None, agent: str = USER_AGENTS["pc"],
              respect_robots: bool = True, out: str = "allowed") -> DataFrame:
    """Adds ``allowed`` to ``urls(site, url, …)``."""
    return can_fetch_as(urls, robots, {out: agent}, respect_robots)
