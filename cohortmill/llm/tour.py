"""Euler tours of forests: successor arcs, distributed list ranking, subtree sums.

A node has an enter and an exit arc. The tour goes from a node's enter arc into
its first child or, without children, to its exit arc; from an exit arc to the
next sibling's enter arc or to the parent's exit arc. What lies between the two
arcs of a node is its subtree, so a subtree sum is the difference of two prefix
sums along the tour.

Prefix sums along a linked list come from list ranking: in every round arcs flip
a coin, and an arc that shows tails takes over a successor that shows heads.
About a quarter of the list goes in each round, until a bounded rest is walked;
then the rounds are undone in reverse. Each round is written, and all rounds
together move about four times the list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortmill.llm import base

#: Arcs that are walked one after the other at the end.
REST = 4096


def coin(round_: int, arc: Column) -> Column:
    return F.xxhash64(F.lit(round_), arc).bitwiseAND(F.lit(1))


def list_rank(arcs: DataFrame, weights: list[str], rest: int = REST) -> DataFrame:
    """(id, weights): for each arc the sums of the weights of all arcs before it in its list.

    ``arcs`` has unique bigints ``id``, the id ``next`` of the successor (null at
    the end of a list) and bigint weights. Every arc has one predecessor at most.
    """
    spark = arcs.sparkSession
    level, undone = base.stored(arcs.select("id", "next", *weights), "tour-list"), []
    while level.count() > rest:
        n = len(undone)
        takes = F.col("next").isNotNull() & (coin(n, F.col("id")) == 0) & (coin(n, F.col("next")) == 1)
        takers = level.filter(takes).select(F.col("id").alias("by"), F.col("next").alias("id"),
                                            *[F.col(w).alias(f"by_{w}") for w in weights])
        met = base.stored(level.filter(coin(n, F.col("id")) == 1).join(takers, "id", "left"), "tour-met")
        taken = met.filter("by is not null")
        undone.append((met, taken.select("id", "by", *[F.col(f"by_{w}").alias(w) for w in weights])))
        smaller = base.stored(
            level.filter((coin(n, F.col("id")) == 0) & ~takes)
            .unionByName(met.filter("by is null").select("id", "next", *weights))
            .unionByName(taken.select(F.col("by").alias("id"), "next", *[
                (F.col(w) + F.col(f"by_{w}")).alias(w) for w in weights])), "tour-list")
        base.discard(level)
        level = smaller

    left = {r["id"]: r for r in level.collect()}
    followers, known = {r["next"] for r in left.values()}, []
    for head in left.keys() - followers:
        at, sums = head, [0] * len(weights)
        while at is not None:
            known.append((at, *sums))
            sums = [s + left[at][w] for s, w in zip(sums, weights)]
            at = left[at]["next"]
    base.discard(level)
    schema = "id bigint, " + ", ".join(f"{w} bigint" for w in weights)
    done = base.stored(spark.createDataFrame(known, schema), "tour-ranks")
    for met, taken in reversed(undone):
        earlier = done.select(F.col("id").alias("by"), *[F.col(w).alias(f"at_{w}") for w in weights])
        done = done.unionByName(base.stored(taken.join(earlier, "by").select(
            "id", *[(F.col(w) + F.col(f"at_{w}")).alias(w) for w in weights]), "tour-ranks"))
        base.discard(met)
    return done


def siblings(nodes: DataFrame) -> DataFrame:
    """``nodes`` (stored: no, parent, place) with ``sibling``, the next one of the same parent by ``place``; stored.

    A parent's children may lie in many ranges; a range's last child gets the next range's first one.
    """
    parts = base.ranged(nodes, [F.col("parent"), F.col("place"), F.col("no")], "tour-siblings")
    inside = Window.partitionBy("part", "parent").orderBy("place", "no")
    pieces = parts.groupBy("part", "parent").agg(F.min(F.struct("place", "no"))["no"].alias("first"))
    after = pieces.select("part", "parent", F.lead("first").over(Window.partitionBy("parent").orderBy("part")).alias("then"))
    return base.stored(parts.join(after, ["part", "parent"]).withColumn(
        "sibling", F.coalesce(F.lead("no").over(inside), F.col("then"))).drop("part", "then"), "tour-next")


def subtree_sums(nodes: DataFrame, weights: list[str], rest: int = REST) -> DataFrame:
    """(no, enter, exit, weights): arc positions in the tour of a node's tree, and sums over its subtree, itself included.

    ``nodes`` (stored) has unique bigints ``no``, ``parent`` (null for roots),
    ``place`` (orders the children of a parent) and bigint weights of the nodes.
    """
    # Roots have no siblings, so that every tree is a list of its own.
    children = siblings(nodes.filter("parent is not null").select("no", "parent", "place"))
    first = children.groupBy("parent").agg(F.min(F.struct("place", "no"))["no"].alias("child")).withColumnRenamed("parent", "no")
    linked = nodes.select("no", "parent", *weights).join(children.select("no", "sibling"), "no", "left").join(first, "no", "left")
    none = [F.lit(0).cast("bigint").alias(w) for w in weights]
    enter = linked.select((F.col("no") * 2).alias("id"), F.coalesce(
        F.col("child") * 2, F.col("no") * 2 + 1).alias("next"), *weights, F.lit(1).cast("bigint").alias("steps"))
    leave = linked.select((F.col("no") * 2 + 1).alias("id"), F.coalesce(
        F.col("sibling") * 2, F.col("parent") * 2 + 1).alias("next"), *none, F.lit(1).cast("bigint").alias("steps"))
    ranks = list_rank(enter.unionByName(leave), [*weights, "steps"], rest)
    return ranks.groupBy(F.shiftright("id", 1).alias("no")).agg(
        F.min("steps").alias("enter"), F.max("steps").alias("exit"),
        *[(F.max(w) - F.min(w)).alias(w) for w in weights])
