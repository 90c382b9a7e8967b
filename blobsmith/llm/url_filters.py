"""URL filters: rules first, then trust and distrust spread over the graph of hosts.

Hosts are joined by the hyperlinks of their pages and to their parent domains, up to two labels. Trust is a PageRank personalised to hosts
with pages that a rule allows and flows along links; distrust is one personalised to hosts with blocked pages and flows
against them, as who links to bad hosts is suspect. A host whose distrust outweighs its trust by `threshold` is blocked.
All of it is DataFrame functions; no Python runs on the executors. Ranks are passed on until they change by less than TOLERANCE in all; a host with
more than a thousandth of all links is dealt to many tasks.

Defined results: a null url, or one without ://, has an empty host and path, fits no rule and is allowed; hosts that no
seed reaches are allowed; null html has no links; null or repeated ids are judged row by row; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, materialize, spread_join


class Rule(NamedTuple):
    """A verdict for a host, its subdomains, and paths that start so."""

    verdict: str
    host: str
    path: str


RULES = (
    Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"),
)
DAMPING = 0.85
#: Ranks are settled once a turn changes them by less than this, summed over hosts. A turn leaves DAMPING of the last change at most,
#: so the turns are bounded too: 24 at 0.85.
TOLERANCE = 0.05
#: A host is blocked if its distrust is more than so many times its trust, both as shares of their totals.
THRESHOLD = 2.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Turns between two written tables, after which the change is looked at.
CUT = 6


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ? or #, A-Z in lower case; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): hyperlinks between hosts, and a step between a host and its parent domain each way, and so on upwards.

    pages: (host, html). Links are counted before the shuffle, so a busy host is a few rows.
    """
    link = r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""
    links = pages.select(
        F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(link), F.lit(1))).alias("dst"))
    links = links.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst")).where("src <> '' and src <> dst")
    links = links.groupBy("src", "dst").agg(F.count("*").alias("n"))
    parts, count = F.split("host", r"\."), F.size(F.split("host", r"\."))
    above = F.transform(F.sequence(F.lit(1), count - 2), lambda i: F.struct(
        F.array_join(F.slice(parts, i, count), ".").alias("host"), F.array_join(F.slice(parts, i + 1, count), ".").alias("parent")))
    ups = pages.select("host").distinct().where(count > 2).select(F.explode(above).alias("e")).select("e.*").distinct()
    ups = ups.select(F.explode(F.array(
        F.struct(F.col("host").alias("src"), F.col("parent").alias("dst")),
        F.struct(F.col("parent").alias("src"), F.col("host").alias("dst")))).alias("e"), F.lit(1).cast("long").alias("n"))
    return links.unionByName(ups.select("e.src", "e.dst", "n")).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust): personalised PageRank from seeds (host, trust, distrust: weights), each total 1.

    Both run as one job over a table of (kind, host): kind 0 goes along the edges, kind 1 against them. What reaches a host without a way
    on ends there.
    """
    ways = edges.select(F.explode(F.array(
        F.struct(F.lit(0).alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "n"),
        F.struct(F.lit(1).alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "n"))).alias("e")).select("e.*")
    total = ways.groupBy("kind", "host").agg(F.sum("n").alias("all"))
    ways = materialize(ways.join(total, ["kind", "host"]).select("kind", "host", "to", (F.col("n") / F.col("all")).alias("share")), "ways")
    each = seeds.select(F.explode(F.array(
        F.struct(F.lit(0).alias("kind"), "host", F.col("trust").cast("double").alias("weight")),
        F.struct(F.lit(1).alias("kind"), "host", F.col("distrust").cast("double").alias("weight")))).alias("s")).select("s.*")
    each = each.where("weight > 0")
    sums = each.groupBy("kind").agg(F.sum("weight").alias("sum"))
    jump = materialize(each.join(F.broadcast(sums), "kind").select("kind", "host", (F.col("weight") / F.col("sum")).alias("score")), "seeds")
    rank, change = jump, 2.0
    hot = materialize(hot_keys(ways, ["kind", "host"]), "hot")
    while change >= tolerance:
        for _ in range(CUT):
            before = rank
            moved = spread_join(ways, before, ["kind", "host"], hot=hot)
            moved = moved.select("kind", F.col("to").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"))
            rank = moved.union(jump.select("kind", "host", F.col("score") * (1 - damping))).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        rank = materialize(rank, "rank")
        both = rank.union(before.select("kind", "host", -F.col("score"))).groupBy("kind", "host").agg(F.sum("score").alias("change"))
        change = both.agg(F.sum(F.abs("change"))).first()[0] or 0.0
    return rank.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("score")).otherwise(0.0)).alias("trust"),
        F.sum(F.when(F.col("kind") == 1, F.col("score")).otherwise(0.0)).alias("distrust"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for each row of pages (page_id, url, html)."""
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    fit = rule_for(F.col("host"), F.col("path"), rules)
    # summed by host before any join, so a host with a third of the pages is a row; its pages are dealt to many tasks to meet it
    seeds = parsed.select("host", fit["verdict"].alias("verdict")).where("host <> '' and verdict is not null").groupBy("host").agg(
        F.sum((F.col("verdict") == "allow").cast("long")).alias("trust"), F.sum((F.col("verdict") == "block").cast("long")).alias("distrust"))
    scores = materialize(propagate(host_edges(parsed.select("host", "html")), seeds, tolerance), "hosts")
    bad = F.coalesce(F.col("distrust") > threshold * F.col("trust"), F.lit(False))
    return (
        spread_join(parsed.drop("html"), scores, "host", "left").withColumn("_fit", fit)
        .select("page_id", "host", "path", F.col("_fit.rule").alias("rule"),
                F.coalesce("_fit.verdict", F.when(bad, "block").otherwise("allow")).alias("verdict"),
                F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    )
