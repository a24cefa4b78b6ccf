"""URL filters: rules, and trust propagated along the host graph.

Rules judge the urls they fit. Their verdicts are the seeds of two personalised
PageRanks over host edges: trust flows from hosts with allowed pages along their
links, distrust flows from hosts with blocked pages against the links, to those
that link to them. Urls without a rule follow their host: it is blocked if its
share of distrust reaches the threshold.
"""

from __future__ import annotations

import string
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from cohortmill.llm import base


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


# The rules of the query.
RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
         Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))
#: Share of rank that follows links, least number of rounds, and the share of distrust that blocks a host.
DAMPING, ROUNDS, THRESHOLD = 0.85, 20, 0.5
#: Rounds end when no host's rank changes by more than this share of it.
TOLERANCE = 1e-4
#: Targets of links in markup that name a host, with or without a scheme.
LINK = r"""(?i:href|src)\s*=\s*["']?\s*((?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^\s"'<>]+)"""


def rest_of(url: Column) -> Column:
    """What follows the first ``://``; empty without one or for null."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(rest_of(url), r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)


def target_host(link: Column) -> Column:
    """The host of a link's target; one that begins with ``//`` has its page's scheme."""
    return host_of(F.when(link.startswith("//"), F.concat(F.lit(":"), link)).otherwise(link))


def path_of(url: Column) -> Column:
    return F.regexp_extract(rest_of(url), r"^[^/?#]*([^?#]*)", 1)


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def by_rule(host: Column, path: Column, rules: tuple[Rule, ...], value) -> Column:
    """``value(rule)`` of the longest rule that fits, else null; of equally long ones the first."""
    out = F.lit(None).cast("string")
    for rule in reversed(sorted(rules, key=lambda r: -len(r.host + r.path))):
        out = F.when(fits(rule, host, path), F.lit(value(rule))).otherwise(out)
    return out


def host_edges(pages: DataFrame, url: str = "url", markup: str = "html") -> DataFrame:
    """Distinct links (source, target) between different hosts."""
    links = pages.select(host_of(base.named(url)).alias("source"),
                         F.explode(F.array_distinct(F.transform(F.regexp_extract_all(
                             base.named(markup), F.lit(LINK), F.lit(1)), target_host))).alias("target"))
    return links.filter("source <> '' and target <> '' and source <> target").distinct()


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS,
              tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) of both PageRanks.

    At least ``rounds`` steps are made, and more until no rank changes by more
    than ``tolerance`` of itself; a host that is reached first changes by all of
    its rank, so every host that links reach has one.

    ``seeds`` has host, trust and distrust, and each of the two is scaled to a
    sum of one. A host passes its rank on in equal parts: trust to the hosts it
    links to, distrust to those that link to it. Rank that has nowhere to go
    returns to the seeds, so each kind keeps a sum of one. Each round is written
    to the shared folder.
    """
    flows = edges.select(F.lit(0).alias("kind"), F.col("source").alias("from"), F.col("target").alias("to")).unionByName(
        edges.select(F.lit(1).alias("kind"), F.col("target").alias("from"), F.col("source").alias("to")))
    parts = base.stored(flows.groupBy("kind", "from").agg(F.count("*").alias("parts")), "host-parts")
    flows = base.stored(flows.join(parts, ["kind", "from"]), "host-flows")
    weights = seeds.select("host", F.explode(F.array(
        F.struct(F.lit(0).alias("kind"), F.col("trust").cast("double").alias("rank")),
        F.struct(F.lit(1).alias("kind"), F.col("distrust").cast("double").alias("rank")))).alias("s")).select(
        "s.kind", "host", "s.rank").filter("rank > 0")
    # One row per kind.
    totals = F.broadcast(weights.groupBy("kind").agg(F.sum("rank").alias("total")))
    start = base.stored(weights.join(totals, "kind").select(
        "kind", "host", (F.col("rank") / F.col("total")).alias("rank")), "host-seeds")
    ranks = start
    done, moving = 0, not flows.isEmpty()
    while moving:
        moved = flows.join(ranks, (flows["kind"] == ranks["kind"]) & (flows["from"] == ranks["host"])).select(
            flows["kind"], F.col("to").alias("host"), (F.col("rank") * damping / F.col("parts")).alias("rank"))
        stuck = ranks.join(parts, (ranks["kind"] == parts["kind"]) & (ranks["host"] == parts["from"]), "leftanti").groupBy(
            "kind").agg(F.sum("rank").alias("stuck"))
        kept = start.join(F.broadcast(stuck), "kind", "left").select("kind", "host", (F.col("rank") * (
            F.lit(1 - damping) + F.coalesce("stuck", F.lit(0.0)) * damping)).alias("rank"))
        was = ranks.select("kind", "host", F.lit(0.0).alias("rank"), F.col("rank").alias("was"))
        after = base.stored(kept.unionByName(moved).withColumn("was", F.lit(0.0)).unionByName(was).groupBy("kind", "host").agg(
            F.sum("rank").alias("rank"), F.sum("was").alias("was")), "host-ranks")
        done += 1
        moving = done < rounds or not after.filter(F.abs(F.col("rank") - F.col("was")) > tolerance * F.col("rank")).isEmpty()
        if ranks is not start:
            base.discard(ranks)
        ranks = after
    return ranks.groupBy("host").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == 0, F.col("rank"))), F.lit(0.0)).alias("trust"),
        F.coalesce(F.sum(F.when(F.col("kind") == 1, F.col("rank"))), F.lit(0.0)).alias("distrust"))


RESULTS = ["host", "path", "rule", "verdict", "trust", "distrust"]


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, url: str = "url", markup: str = "html",
          threshold: float = THRESHOLD) -> DataFrame:
    """All columns but the markup, and host, path, rule, verdict, trust, distrust (input ones are replaced).

    A host's seeds are the shares of its ruled pages that are allowed and that
    are blocked, however many pages of it the table holds. Null urls and urls
    without ``://`` have an empty host and path. A page without a rule whose
    host has no rank at all, or no host, is allowed.
    """
    carried = [c for c in base.beside(pages, RESULTS) if c != markup]
    host, path = host_of(base.named(url)), path_of(base.named(url))
    judged = pages.select(F.struct(*[base.named(c).alias(c) for c in carried]).alias("_row"), host.alias("host"), path.alias("path"))
    judged = judged.withColumns({
        "rule": by_rule(F.col("host"), F.col("path"), rules, lambda r: r.host + r.path),
        "ruled": by_rule(F.col("host"), F.col("path"), rules, lambda r: r.verdict)})
    shares = judged.filter("ruled is not null").groupBy("host").agg(
        F.avg((F.col("ruled") == "allow").cast("int")).alias("trust"),
        F.avg((F.col("ruled") == "block").cast("int")).alias("distrust"))
    ranks = propagate(host_edges(pages, url, markup), shares)
    known = judged.join(ranks, "host", "left").withColumns({
        "trust": F.coalesce("trust", F.lit(0.0)), "distrust": F.coalesce("distrust", F.lit(0.0))})
    bad = (F.col("distrust") > 0) & (F.col("distrust") >= threshold * (F.col("trust") + F.col("distrust")))
    return known.select("_row.*", "host", "path", "rule", F.coalesce(
        "ruled", F.when(bad, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "trust", "distrust")
