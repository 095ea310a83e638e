"""URL verdicts by rules, and by trust that spreads over links between hosts. DataFrame functions only.

A rule (host, path) fits its host and all its subdomains where the url's path begins with the rule's path;
the longest rule that fits decides. Urls without a rule take their host's verdict: personalised PageRank
carries trust from hosts along their links, and distrust from hosts against them. A host's seed is the share
of its pages that rules allow, or block. A host is blocked whose distrust exceeds its trust by the
threshold, which is what a host without links reaches if rules block half of its pages.

Host edges are the urls with a host of their own in href attributes, with or without a scheme, counted by pair of
hosts, and one edge each way between a host and the domain above it (a.b.c and b.c; not the last label alone).
ROUNDS rounds leave less than DAMPING ** ROUNDS of the seeds' mass unspread, on any graph.

Nulls: a null url, or one without "://", has an empty host and path, no seed and no edges; a null html has no
links. Repeated rows are pages of their own, an empty table gives no rows. Balances are rounded to nine places, so
that the order of summation decides no verdict; one that equals the threshold is allowed. A page of any length
is one pass of one pattern. Columns besides page_id, url and html are ignored, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

# The rules of the production query as (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
DAMPING, ROUNDS = 0.85, 48
#: Rounds of one job: its result is written to cut the lineage.
_STEP = 6
THRESHOLD = (1 - DAMPING) / 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    host = F.regexp_extract(after, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(after, F.length(host) + 1, F.length(after)), "^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def by_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):  # the last one set is the longest
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _above(host: Column) -> Column:
    """(of, to) from a host to the domain above it, and so on up to two labels."""
    labels = F.split(host, r"\.")
    suffix = lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    return F.when(F.size(labels) > 2, F.transform(F.sequence(F.lit(1), F.size(labels) - 2), lambda i: F.struct(suffix(i).alias("of"), suffix(i + 1).alias("to"))))


def _spread(scratch: Scratch, seeds: DataFrame, edges: DataFrame, rounds: int, damping: float) -> DataFrame:
    """seeds (side, host, seed), edges (side, of, to, share) to (side, host, mass)."""
    rest = scratch.write(seeds.select("side", "host", (F.col("seed") * (1 - damping)).alias("mass")), "rest")
    mass = rest
    for done in range(1, rounds + 1):
        moved = mass.join(edges, (mass["side"] == edges["side"]) & (mass["host"] == edges["of"])).select(mass["side"], F.col("to").alias("host"), (damping * F.col("mass") * F.col("share")).alias("mass"))
        mass = rest.union(moved).groupBy("side", "host").agg(F.sum("mass").alias("mass"))
        if done % _STEP == 0 or done == rounds:
            mass = scratch.write(mass, "mass")
    return mass


def verdicts(spark: SparkSession, pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, rounds: int = ROUNDS, damping: float = DAMPING, threshold: float = THRESHOLD) -> DataFrame:
    scratch = Scratch(spark, "urls")
    host, path = host_and_path(pages["url"])
    rule, verdict = by_rule(F.col("host"), F.col("path"), rules)
    urls = pages.select(pages["page_id"].cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    judged = urls.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"))

    target = F.regexp_extract_all("html", F.lit(r"""(?i)\bhref\s*+=\s*+["']?\s*+(?:[a-z][a-z0-9+.-]*+:)?+//([^/?#"'\s>]++)"""), F.lit(1))
    linked = pages.select(host.alias("of"), pages["html"].alias("html")).where(F.contains("html", F.lit("//"))).select("of", F.explode(target).alias("to"))
    linked = linked.select("of", F.translate("to", _UPPER, _LOWER).alias("to")).where("of <> to and of <> ''")
    linked = scratch.write(linked.groupBy("of", "to").agg(F.count(F.lit(1)).cast("double").alias("n")), "links")

    share = lambda v: F.avg(F.when(F.col("by_rule") == v, 1.0).otherwise(0.0))
    seeds = scratch.write(judged.where("host <> ''").groupBy("host").agg(share("allow").alias("trusted"), share("block").alias("blocked")), "seeds")
    hosts = seeds.select("host").union(linked.select("to")).distinct()
    above = hosts.select(F.explode(_above(F.col("host"))).alias("e")).select("e.of", "e.to").distinct().withColumn("n", F.lit(1.0))
    both = linked.union(above).union(above.select(F.col("to").alias("of"), F.col("of").alias("to"), "n")).groupBy("of", "to").agg(F.sum("n").alias("n"))
    both = scratch.write(both, "edges")
    edges = both.select(F.lit("trusted").alias("side"), "of", "to", "n").union(both.select(F.lit("blocked"), F.col("to"), F.col("of"), "n"))
    total = edges.groupBy("side", "of").agg(F.sum("n").alias("all"))
    edges = scratch.write(edges.join(total, ["side", "of"]).select("side", "of", "to", (F.col("n") / F.col("all")).alias("share")), "shares")
    sides = seeds.select("host", F.explode(F.create_map(F.lit("trusted"), F.col("trusted"), F.lit("blocked"), F.col("blocked"))).alias("side", "seed")).where("seed > 0")
    mass = _spread(scratch, sides, edges, rounds, damping)
    score = mass.groupBy("host").agg(F.round(F.sum(F.when(F.col("side") == "blocked", F.col("mass")).otherwise(-F.col("mass"))), 9).alias("against"))
    blocked = score.where(F.col("against") > threshold).select("host", F.lit("block").alias("by_host"))
    return judged.join(blocked, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("by_rule", "by_host", F.lit("allow")).alias("verdict"))
