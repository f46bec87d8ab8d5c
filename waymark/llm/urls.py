"""URL filters: rules first, link-graph propagation for the rest.

A rule names a host, which stands for its subdomains too, and a path prefix; the longest rule
that fits decides. For pages without a rule the host is judged. Hosts with pages that a rule
allows are trusted seeds, hosts with blocked pages are blocked seeds, in proportion to those
pages. Trust follows the links between hosts (personalised PageRank from the trusted seeds);
distrust follows them backwards, from a blocked host to those that link to it. Hosts without
links give their rank back to the seeds.

Scaled by the number of seed pages, the ranks are what a host stands for in allowed and in
blocked pages. A host is blocked if blocked pages are at least half of these and its pages
without a rule. Without links between hosts that is the plain share of its own pages.

Ranks are iterated until a step changes them by less than ``SETTLED`` in all. Each step changes
them by 0.85 of the last change at most, so that takes at most 137 steps, and what is left
unsettled is below 0.85 / 0.15 of the last change: 6e-9 of the seeds. ``SQL`` takes all 137.

Host and path of a missing url, or one without ``://``, are empty; the empty host is judged like
any other. Links are the absolute or scheme-relative targets of ``href``; relative links stay on
the host and carry nothing. Repeated pages count each. An empty table gives no rows. Only
``page_id``, ``url`` and ``html`` are read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.tables import narrow, stored, table

DAMPING, SETTLED = 0.85, 1e-9
SQL_STEPS = 137  # all the steps that settling can take
BLOCKED_SHARE = 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"(?i)href\s*+=\s*+[\"']?\s*+(?:https?:)?//([^/?#\"'\s>]++)"


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)


def _low(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return _low(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``pages`` with ``host, path``, the longest fitting ``rule`` and its ``ruled`` verdict."""
    host, path = host_and_path(F.col("url"))
    out = pages.withColumns({"host": host, "path": path})
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # a later fit is a longer one
        fits = ((F.col("host") == r.host) | F.col("host").endswith(f".{r.host}")) & F.col("path").startswith(r.path)
        rule, verdict = F.when(fits, r.text).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return out.withColumns({"rule": rule, "ruled": verdict})


def host_links(pages: DataFrame) -> DataFrame:
    """``source, target, links`` between different hosts, counted over all pages."""
    targets = pages.select(F.col("host").alias("source"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("target"))
    targets = targets.withColumn("target", _low(F.col("target"))).where(F.col("source") != F.col("target"))
    return targets.groupBy("source", "target").agg(F.count("*").alias("links"))


def _moves(links: DataFrame) -> DataFrame:
    """Where rank goes from a host, and which share: along links for trust, against for distrust."""
    kinds = links.select(F.lit("trust").alias("kind"), F.col("source").alias("origin"), F.col("target").alias("host"), "links").unionByName(
        links.select(F.lit("distrust").alias("kind"), F.col("target").alias("origin"), F.col("source").alias("host"), "links")
    )
    sums = kinds.groupBy("kind", "origin").agg(F.sum("links").alias("all_links"))
    return kinds.join(sums, ["kind", "origin"]).select("kind", "origin", "host", (F.col("links") / F.col("all_links")).alias("share"))


def propagated(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """Settled ranks ``kind, host, rank`` from ``seeds (kind, host, start)``, whose starts sum to
    one per kind, over ``links``."""
    moves = stored(_moves(links), "moves")
    leaving = moves.select("kind", F.col("origin").alias("host")).distinct().withColumn("leaves", F.lit(True))
    reached = moves.select("kind", "host").distinct().withColumn("start", F.lit(0.0))
    ranks = seeds.unionByName(reached).groupBy("kind", "host").agg(F.sum("start").alias("start"))
    ranks = ranks.join(leaving, ["kind", "host"], "left").select("kind", "host", "start", F.coalesce("leaves", F.lit(False)).alias("leaves"))
    ranks = stored(ranks.withColumns({"rank": F.col("start"), "last": F.lit(0.0)}), "ranks")
    stuck = lambda kind: F.sum(F.when((F.col("kind") == kind) & ~F.col("leaves"), F.col("rank")))
    state = lambda df: [x or 0.0 for x in df.agg(F.sum(F.abs(F.col("rank") - F.col("last"))), stuck("trust"), stuck("distrust")).first()]
    change, trust, distrust = state(ranks)
    while change >= SETTLED:
        back = F.when(F.col("kind") == "trust", trust).otherwise(distrust)
        flow = moves.join(ranks.select("kind", F.col("host").alias("origin"), "rank"), ["kind", "origin"])
        flow = flow.groupBy("kind", "host").agg(F.sum(F.col("rank") * F.col("share")).alias("flow"))
        gained = DAMPING * (F.coalesce("flow", F.lit(0.0)) + back * F.col("start"))
        stepped = ranks.drop("last").withColumnRenamed("rank", "last").join(flow, ["kind", "host"], "left")
        ranks = stored(stepped.withColumn("rank", (1 - DAMPING) * F.col("start") + gained).drop("flow"), "ranks")
        change, trust, distrust = state(ranks)
    return ranks.select("kind", "host", "rank")


def blocked_hosts(pages: DataFrame) -> DataFrame:
    """The hosts that link propagation blocks, from ruled pages with ``html``."""
    count = lambda c: F.sum(c.cast("long"))
    hosts = pages.groupBy("host").agg(
        count(F.coalesce(F.col("ruled") == "allow", F.lit(False))).alias("trust"),
        count(F.coalesce(F.col("ruled") == "block", F.lit(False))).alias("distrust"),
        count(F.col("ruled").isNull()).alias("free"),
    )
    hosts = stored(hosts, "hosts")
    allowed, blocked = (x or 0 for x in hosts.agg(F.sum("trust"), F.sum("distrust")).first())
    links = stored(host_links(pages), "links")
    seeds = hosts.select("host", F.lit("trust").alias("kind"), (F.col("trust") / F.lit(float(max(allowed, 1)))).alias("start")).unionByName(
        hosts.select("host", F.lit("distrust").alias("kind"), (F.col("distrust") / F.lit(float(max(blocked, 1)))).alias("start"))
    )
    ranks = propagated(seeds.where("start > 0"), links)
    stands_for = ranks.select(
        "host",
        F.when(F.col("kind") == "trust", F.col("rank") * float(allowed)).otherwise(0.0).alias("good"),
        F.when(F.col("kind") == "distrust", F.col("rank") * float(blocked)).otherwise(0.0).alias("bad"),
    ).unionByName(hosts.select("host", F.col("free").cast("double").alias("good"), F.lit(0.0).alias("bad")))
    sums = stands_for.groupBy("host").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    return sums.where((F.col("bad") > 0) & (F.round(F.col("bad") / (F.col("bad") + F.col("good")), 9) >= BLOCKED_SHARE)).select("host")


def judged(pages: DataFrame) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page."""
    known = ruled(pages.select("page_id", "url", "html"))
    bad = narrow(stored(blocked_hosts(known), "blocked").withColumn("blocked", F.lit(True)))
    method = F.when(F.col("blocked"), "block").otherwise("allow")
    return known.join(bad, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))


def _rule_sql(field: str) -> str:
    cases = " ".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{getattr(r, field)}'"
        for r in sorted(RULES, key=lambda r: -len(r.text))
    )
    return f"CASE {cases} END"


SQL = f"""
WITH RECURSIVE cut AS (
    SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
),
parts AS (
    SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM cut
),
known AS (SELECT *, {_rule_sql("text")} AS rule, {_rule_sql("verdict")} AS ruled FROM parts),
hosts AS (
    SELECT host, count(*) FILTER (ruled = 'allow') AS trust, count(*) FILTER (ruled = 'block') AS distrust, count(*) FILTER (ruled IS NULL) AS free
    FROM known GROUP BY host
),
totals AS (SELECT CAST(sum(trust) AS DOUBLE) AS allowed, CAST(sum(distrust) AS DOUBLE) AS blocked FROM hosts),
targets AS (
    SELECT host AS source, translate(unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']?\\s*(?:https?:)?//([^/?#"''\\s>]+)', 1)), '{_UPPER}', '{_LOWER}') AS target
    FROM known
),
links AS (SELECT source, target, count(*) AS links FROM targets WHERE source <> target GROUP BY ALL),
kinds AS (
    SELECT 'trust' AS kind, source AS origin, target AS host, links FROM links
    UNION ALL SELECT 'distrust', target, source, links FROM links
),
moves AS (SELECT kind, origin, host, links / sum(links) OVER (PARTITION BY kind, origin) AS share FROM kinds),
nodes AS (
    SELECT kind, host, sum(start) AS start, bool_or(leaves) AS leaves FROM (
        SELECT 'trust' AS kind, host, trust / allowed AS start, false AS leaves FROM hosts, totals WHERE trust > 0
        UNION ALL SELECT 'distrust', host, distrust / blocked, false FROM hosts, totals WHERE distrust > 0
        UNION ALL SELECT kind, host, 0.0, false FROM moves
        UNION ALL SELECT kind, origin, 0.0, true FROM moves WHERE (kind, origin) IN (SELECT (kind, host) FROM moves)
            OR (kind = 'trust' AND origin IN (SELECT host FROM hosts WHERE trust > 0)) OR (kind = 'distrust' AND origin IN (SELECT host FROM hosts WHERE distrust > 0))
    ) GROUP BY kind, host
),
ranks AS (
    SELECT 0 AS step, kind, host, start, leaves, CAST(start AS DOUBLE) AS rank FROM nodes
    UNION ALL
    SELECT any_value(step) + 1, n.kind, n.host, any_value(n.start), any_value(n.leaves), (1 - {DAMPING}) * any_value(n.start) + {DAMPING} * sum(gained)
    FROM (
        SELECT r.step, m.kind, m.host, r.rank * m.share AS gained FROM ranks r JOIN moves m ON m.kind = r.kind AND m.origin = r.host WHERE r.step < {SQL_STEPS}
        UNION ALL
        SELECT r.step, n.kind, n.host, CASE WHEN r.leaves THEN 0 ELSE r.rank * n.start END FROM ranks r JOIN nodes n ON n.kind = r.kind WHERE r.step < {SQL_STEPS}
    ) g JOIN nodes n ON n.kind = g.kind AND n.host = g.host
    GROUP BY n.kind, n.host
),
stands_for AS (
    SELECT host, CASE WHEN kind = 'trust' THEN rank * allowed ELSE 0 END AS good, CASE WHEN kind = 'distrust' THEN rank * blocked ELSE 0 END AS bad
    FROM ranks, totals WHERE step = {SQL_STEPS}
    UNION ALL SELECT host, free, 0 FROM hosts
),
bad_hosts AS (
    SELECT host FROM stands_for GROUP BY host HAVING sum(bad) > 0 AND round(sum(bad) / (sum(bad) + sum(good)), 9) >= {BLOCKED_SHARE}
)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN host IN (SELECT host FROM bad_hosts) THEN 'block' ELSE 'allow' END) AS verdict
FROM known
"""
