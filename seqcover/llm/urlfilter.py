"""URL filters: rules on hosts and paths, and for the rest trust and distrust spread over the links between hosts.

Native: DataFrame functions only. A rule fits its host and all its subdomains where the url's path starts with the
rule's; the longest wins (of equal ones that of the longer host, then a block). Pages without a rule take their host's
verdict: personalised PageRank from hosts with allowed pages goes forward along links, distrust from hosts with blocked
pages goes backward, and a host is blocked if it has more distrust than RATIO times its trust; a host that neither
reaches is allowed. A host's seed is the share of its pages with a rule that are allowed (blocked), in UNIT; ranks are
whole numbers, so that the order of sums doesn't matter and every engine gets the same (mass under one unit is lost).
Links are absolute or start with //; links within a host don't count, and several between two hosts are one.

A null url, or one without ://, has an empty host and path: no rule fits, and the empty host is judged like any other.
A null html has no links. Repeated rows and rows without an id are judged one by one; other columns don't matter; no
pages, no rules or no links give no rows, no rule or no spreading. Pages are shuffled only as counts by host and as
distinct host pairs. What is joined to them by host is one row a host, broadcast if it is under BROADCAST_BYTES.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Action, host and path.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: A whole seed. Ranks stay in 64 bits with up to 500 million seeds whose mass meets in one host.
UNIT = 10**9
#: The part of a rank that is passed on, in twentieths, and the rounds.
DAMPING, ROUNDS = 17, 20
RATIO = 1
BROADCAST_BYTES = 32 << 20
#: Link tags end at the next < or >, so that broken markup is searched once.
LINK = r"""(?i)<a(?:[ \t\n\f\r]|[ \t\n\f\r][^<>]*?[ \t\n\f\r"'])href[ \t\n\f\r]*=[ \t\n\f\r]*["']?[ \t\n\f\r]*((?:https?:)?//[^/?#"' \t\n\f\r<>]+)"""


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    return F.coalesce(_lower(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "action string, host string, path string")


def _sized(side: DataFrame) -> DataFrame:
    """A stored table by host, marked for broadcast if its bytes are few."""
    size = side.agg(F.sum(F.octet_length("_host") + 64 + F.coalesce(F.aggregate("_rules", F.lit(0), lambda a, r: a + 48 + F.octet_length(r["rule"]) + F.octet_length(r["path"])), F.lit(0)) if "_rules" in side.columns else F.octet_length("_host") + 64)).first()[0]
    return F.broadcast(side) if (size or 0) <= BROADCAST_BYTES else side


def rules_of_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """_host and _rules (path, rule, action of each that fits the host) of those hosts (a column _host) that have any."""
    named = rules.select(F.col("host").alias("_at"), "path", F.concat("host", "path").alias("rule"), "action", F.length("host").alias("n_host"))
    # no more names of a host are looked up than rules have labels
    labels = rules.agg(F.coalesce(F.max(F.size(F.split("host", r"\."))), F.lit(0))).first()[0]
    own = F.split("_host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.least(F.size(own), F.lit(max(1, labels)))), lambda k: F.array_join(F.slice(own, -k, k), "."))
    fits = hosts.select("_host", F.explode(ends).alias("_at")).join(named, "_at")
    return fits.groupBy("_host").agg(F.collect_set(F.struct("path", "rule", "action", "n_host")).alias("_rules"))


def best_rule(rules: Column, path: Column) -> Column:
    """The longest of a host's rules whose path the url's path starts with."""
    ordered = F.transform(F.filter(rules, lambda r: F.startswith(path, r["path"])), lambda r: F.struct(F.length(r["rule"]).alias("n"), r["n_host"].alias("n_host"), r["action"].alias("action"), r["rule"].alias("rule")))
    return F.array_max(ordered)


def links(pages: DataFrame) -> DataFrame:
    """src and dst of every pair of unlike hosts of which one links to the other."""
    found = F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.col("html"), F.lit(LINK), F.lit(1)), lambda x: host(F.when(F.startswith(x, F.lit("//")), F.concat(F.lit("http:"), x)).otherwise(x)))))
    return pages.where("html is not null").select(host(F.col("url")).alias("src"), found.alias("dst")).where("src <> dst and src <> '' and dst <> ''").distinct()


def spread(seeds: DataFrame, edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """side, host and rank from seeds (side, host, seed) along edges (side, src, dst; a stored table). Each round is one join and one sum."""
    base = common.stored(seeds.where("seed > 0").selectExpr("side", "host", f"{20 - DAMPING} * seed div 20 AS rank"), "seeds")
    if edges.isEmpty():
        return base
    out = common.stored(edges.join(edges.groupBy("side", "src").agg(F.count(F.lit(1)).alias("degree")), ["side", "src"]), "degrees")
    ranks = base
    for _ in range(rounds):
        passed = ranks.withColumnRenamed("host", "src").join(out, ["side", "src"]).selectExpr("side", "dst AS host", f"{DAMPING} * rank div (20 * degree) AS rank")
        after = common.stored(passed.where("rank > 0").unionByName(base).groupBy("side", "host").agg(F.sum("rank").alias("rank")), "ranks")
        if ranks is not base:
            common.forget(ranks)
        ranks = after
    common.forget(out)
    common.forget(base)
    return ranks


def judged(pages: DataFrame, rules: DataFrame, ratio: int = RATIO, rounds: int = ROUNDS) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of every page (page_id, url, html)."""
    parsed = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    hosts = parsed.groupBy(F.col("host").alias("_host")).agg(F.count(F.lit(1)).alias("n"))
    known = _sized(common.stored(rules_of_hosts(hosts, rules), "host_rules"))
    ruled = parsed.join(known, parsed["host"] == known["_host"], "left").withColumn("_best", best_rule(F.col("_rules"), F.col("path"))).drop("_host", "_rules")
    counted = ruled.where("_best is not null").groupBy("host").agg(F.count(F.when(F.col("_best.action") == "allow", 1)).alias("allowed"), F.count(F.lit(1)).alias("n"))
    counted = common.stored(counted, "counted")
    side = lambda k, mass: counted.select(F.lit(k).alias("side"), "host", F.expr(f"({mass}) * {UNIT} div n").alias("seed"))
    pairs = common.stored(links(pages), "links")
    edges = pairs.select(F.lit(0).alias("side"), "src", "dst").unionByName(pairs.select(F.lit(1).alias("side"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    ranks = spread(side(0, "allowed").unionByName(side(1, "n - allowed")), edges, rounds)
    value = lambda k: F.coalesce(F.sum(F.when(F.col("side") == k, F.col("rank"))), F.lit(0))
    reached = _sized(common.stored(ranks.groupBy(F.col("host").alias("_host")).agg(value(0).alias("trust"), value(1).alias("distrust")), "reached"))
    common.forget(counted)
    common.forget(pairs)
    common.forget(ranks)
    out = ruled.join(reached, ruled["host"] == reached["_host"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("trust", "distrust")})
    verdict = F.coalesce(F.col("_best.action"), F.when(F.col("distrust") > ratio * F.col("trust"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("_best.rule").alias("rule"), verdict.alias("verdict"), "trust", "distrust")


def kept(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages whose url is allowed, with the same columns; rows of one page_id are told apart by their url."""
    allowed = judged(pages.withColumn("page_id", F.struct("page_id", "url")), rules).where("verdict = 'allow'").select(F.col("page_id").alias("_key")).distinct()
    return pages.join(allowed, F.struct("page_id", "url").eqNullSafe(F.col("_key")), "left_semi")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return judged(pages, rule_table(spark, RULES))


def oracle() -> str:
    values = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES)
    link = LINK.replace("'", "''")
    lower = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    rounds = ",\n".join(
        f"r{k} AS MATERIALIZED (SELECT side, host, CAST(sum(rank) AS BIGINT) AS rank FROM (SELECT * FROM r0 UNION ALL SELECT side, dst, {DAMPING} * rank // (20 * degree) FROM (SELECT side, host AS src, rank FROM r{k - 1}) JOIN degrees USING (side, src)) GROUP BY ALL)"
        for k in range(1, ROUNDS + 1)
    )
    return rf"""
WITH rules AS (SELECT * FROM (VALUES {values}) AS v(action, rule_host, rule_path)),
p AS (SELECT row_number() OVER () AS row_id, page_id, html,
             coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), {lower}), '') AS host,
             coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
best AS (SELECT row_id, arg_max(struct_pack(action := action, rule := rule_host || rule_path), (length(rule_host || rule_path), length(rule_host), action)) AS b
         FROM p JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY row_id),
ruled AS (SELECT p.*, b.action AS action, b.rule AS rule FROM p LEFT JOIN best USING (row_id)),
counted AS (SELECT host, count(*) FILTER (WHERE action = 'allow') AS allowed, count(*) AS n FROM ruled WHERE action IS NOT NULL GROUP BY host),
seeds AS (SELECT 0 AS side, host, allowed * {UNIT} // n AS seed FROM counted UNION ALL SELECT 1, host, (n - allowed) * {UNIT} // n FROM counted),
found AS (SELECT host AS src, unnest(regexp_extract_all(html, '{link}', 1)) AS l FROM p),
pairs AS (SELECT DISTINCT src, dst FROM (SELECT src, translate(regexp_extract(CASE WHEN l LIKE '//%' THEN 'http:' || l ELSE l END, '^(?s:.*?)://([^/?#]*)', 1), {lower}) AS dst FROM found) WHERE src <> dst AND src <> '' AND dst <> ''),
e AS (SELECT 0 AS side, src, dst FROM pairs UNION ALL SELECT 1, dst, src FROM pairs),
degrees AS MATERIALIZED (SELECT side, src, dst, count(*) OVER (PARTITION BY side, src) AS degree FROM e),
r0 AS MATERIALIZED (SELECT side, host, CAST({20 - DAMPING} * seed // 20 AS BIGINT) AS rank FROM seeds WHERE seed > 0),
{rounds},
reached AS (SELECT host, CAST(coalesce(sum(rank) FILTER (WHERE side = 0), 0) AS BIGINT) AS trust, CAST(coalesce(sum(rank) FILTER (WHERE side = 1), 0) AS BIGINT) AS distrust FROM r{ROUNDS} GROUP BY host)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN coalesce(distrust, 0) > {RATIO} * coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict, coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust
FROM ruled LEFT JOIN reached USING (host)
"""


ORACLE = oracle()
