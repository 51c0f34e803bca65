"""Allow and block rules for urls, and trust that spreads over the link graph of hosts where no rule fits.

A rule ``(verdict, host, path)`` fits its host and all subdomains if the url's path starts with the rule's; of several
the longest wins, of equally long ones a block. Hosts get their fitting rules once, and pages take them from there.

Pages that no rule fits are judged by their host. Every page that a rule allows (blocks) gives its host one unit of
trust (distrust). Trust follows links from host to host, distrust runs against them: a round passes 17/20 of a host's
score on in equal shares and adds 3/20 of its own units, which is personalised PageRank without the return of mass from
hosts that link nowhere. Scores are whole numbers of millionths and only grow, so sums don't depend on their order,
and rounds stop when nothing changes or after ``rounds``. A host is blocked if more distrust than trust reaches it.

Links are ``href``, ``src`` and ``action`` values with a host of their own; each pair of hosts counts once, links inside
a host not at all.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed; null html
has no links; every row of ``pages`` gives one row, repeated and null ids too; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeworks.plans.lineage import discard, materialise

#: Units of a judged page; a share of 17 of 20 goes on.
UNIT, KEEP, PASS, WHOLE = 1_000_000, 3, 17, 20
LINK = r"""(?:[hH][rR][eE][fF]|[sS][rR][cC]|[aA][cC][tT][iI][oO][nN])[ \t\r\n]*=[ \t\r\n]*["']?[ \t\r\n]*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#"'<> \t\r\n]+)"""
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_parts(pages: DataFrame) -> DataFrame:
    """``(page_id, host, path, html)``."""
    part = lambda i: F.coalesce(F.regexp_extract("url", _URL, i), F.lit(""))
    return pages.select("page_id", _ascii_lower(part(1)).alias("host"), part(2).alias("path"), "html")


def host_edges(parts: DataFrame) -> DataFrame:
    """``(src, dst)``: pairs of different hosts of which the first links to the second."""
    links = parts.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))).alias("dst"))
    return links.select("src", _ascii_lower(F.col("dst")).alias("dst")).where("src <> dst").distinct()


def _dealt(left: DataFrame, right: DataFrame, key: str, salts: int) -> DataFrame:
    """Left join on ``key``, unique in ``right``; rows of one key go to ``salts`` tasks, so that a hot key fills none."""
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [key, "_salt"], "left").drop("_salt")


def with_rules(parts: DataFrame, rules: DataFrame, salts: int = 16) -> DataFrame:
    """``(page_id, host, path, rule, verdict)``: the longest rule ``(verdict, host, path)`` that fits, or null.

    All rules of a host and of the domains above it make one list; lists of a domain are as long as its rules.
    """
    depth = rules.agg(F.coalesce(F.max(F.size(F.split("host", r"\."))), F.lit(0))).first()[0]
    own = rules.select(F.col("host").alias("domain"), F.struct(F.length(F.concat("host", "path")).alias("size"), (F.col("verdict") == "block").alias("block"), "path", F.concat("host", "path").alias("rule")).alias("r"))
    own = own.groupBy("domain").agg(F.collect_set("r").alias("r"))
    labels = F.split("host", r"\.")
    domains = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(max(depth, 1))), lambda i: F.array_join(F.slice(labels, F.greatest(F.size(labels) - i + 1, F.lit(1)), i), ".")))
    named = _dealt(parts.select("host").distinct().select("host", F.explode(domains).alias("domain")), own, "domain", salts).where("r is not null")
    lists = named.groupBy("host").agg(F.flatten(F.collect_list("r")).alias("r"))
    best = F.array_max(F.filter("r", lambda r: F.startswith(F.col("path"), r["path"])))
    found = _dealt(parts.select("page_id", "host", "path"), lists, "host", salts).withColumn("best", best)
    return found.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.when(F.col("best.block"), "block").when(~F.col("best.block"), "allow").alias("verdict"))


def propagate(seeds: DataFrame, edges: DataFrame, rounds: int = 20) -> DataFrame:
    """``(kind, host, score)`` from ``seeds (kind, host, units)`` and ``edges (kind, src, dst)``: shares of each score go from src to dst.

    Each round is written to the shared checkpoint folder.
    """
    degree = edges.groupBy("kind", "src").agg(F.count(F.lit(1)).alias("degree"))
    ways = materialise(edges.join(degree, ["kind", "src"]))
    own = seeds.select("kind", "host", F.expr(f"units * {KEEP} div {WHOLE}").alias("score"))
    state, seen = materialise(own), None
    for _ in range(rounds):
        flow = ways.join(state.withColumnRenamed("host", "src"), ["kind", "src"]).select("kind", F.col("dst").alias("host"), F.expr(f"score * {PASS} div (degree * {WHOLE})").alias("score"))
        after = materialise(own.union(flow).groupBy("kind", "host").agg(F.sum("score").alias("score")))
        discard(state)
        state, mark = after, tuple(after.agg(F.count(F.lit(1)), F.sum("score")).first())
        if mark == seen:
            break
        seen = mark
    return state


def judge(pages: DataFrame, rules: DataFrame, rounds: int = 20, salts: int = 16) -> DataFrame:
    """``(page_id, host, path, rule, verdict, trust, distrust)`` of every page."""
    parts = with_parts(pages)
    edges = materialise(host_edges(parts))
    ruled = materialise(with_rules(parts.select("page_id", "host", "path"), rules, salts))
    seeds = materialise(ruled.where("verdict is not null").groupBy(F.col("verdict").alias("kind"), "host").agg((F.count(F.lit(1)) * UNIT).alias("units")))
    ways = edges.select(F.lit("allow").alias("kind"), "src", "dst").union(edges.select(F.lit("block"), F.col("dst"), F.col("src")))
    scores = propagate(seeds, ways, rounds).groupBy("host").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0).cast("long")).alias(n) for k, n in (("allow", "trust"), ("block", "distrust"))])
    known = _dealt(ruled, scores, "host", salts).select("page_id", "host", "path", "rule", "verdict", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("trust", "distrust")])
    return known.withColumn("verdict", F.coalesce("verdict", F.when(F.col("distrust") > F.col("trust"), "block").otherwise("allow")))
