"""Prefix trie of conversations: what training saves if shared beginnings are read once.

Every distinct sequence of first turns is a node. A sequence is known by two
64-bit sums (exclusive or) of hashes of its turns with their places; so a turn's
node and its parent's come from running sums over parts of a conversation, and
no conversation must lie in one task. Subtree figures come from the Euler tour
of the trie (``tour``).

Texts are read once and not shuffled: a turn travels as the md5 of its role and
text, with its number of code points.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window, functions as F

from cohortmill.llm import base, tour


class Steps(NamedTuple):
    """turns: conv, part, place (from 1), m, chars, total, with parts ascending along a conversation; convs: conv, total."""
    turns: DataFrame
    convs: DataFrame


def numbered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Steps:
    """Turns in order: by turn (null first), then by the md5 of role and text; equal rows are interchangeable.

    Null roles and texts are empty. Rows without a conversation take no part.
    """
    roles, texts = (F.coalesce(base.named(c).cast("string"), F.lit("")) for c in (role, text))
    rows = base.stored(turns.filter(base.named(conv).isNotNull()).select(
        base.named(conv).alias("conv"), base.named(turn).alias("turn"),
        F.md5(F.concat(F.length(roles).cast("string"), F.lit(":"), roles, texts)).alias("m"),
        F.length(texts).cast("bigint").alias("chars"), F.monotonically_increasing_id().alias("no")), "trie-turns")
    order = [F.col("turn").asc_nulls_first(), F.col("m"), F.col("no")]
    parts = base.ranged(rows, [F.col("conv"), *order], "trie-parts")
    pieces = parts.groupBy("conv", "part").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("conv")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("conv", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
                           F.sum("n").over(whole).alias("total"))
    inside = Window.partitionBy("conv", "part").orderBy(*order)
    steps = base.stored(parts.join(pieces, ["conv", "part"]).select(
        "conv", "part", (F.col("before") + F.row_number().over(inside)).alias("place"), "m", "chars", "total"), "trie-steps")
    return Steps(steps, base.stored(steps.groupBy("conv").agg(F.max("total").alias("total")), "trie-convs"))


def with_borrowed_heads(steps: Steps, every: int = 100, most: int = 5) -> Steps:
    """Conversations that begin with the head of another one.

    Of conversation c the first h turns are replaced by the first h (all, if
    fewer; none, if it is missing) of conversation c - c % every, where h is
    crc32 of the decimal c modulo ``most`` + 1. ``conv`` must be a number.
    """
    c = F.col("conv")
    lenders = steps.convs.filter(c % every == 0).select(c.alias("lender"), F.col("total").alias("lent"))
    h = F.crc32(c.cast("string").cast("binary")) % (most + 1)
    plan = steps.convs.select("conv", (c - c % every).alias("lender"), h.alias("h"), "total").join(lenders, "lender", "left")
    head = F.least("h", F.coalesce("lent", F.lit(0)))
    convs = base.stored(plan.select("conv", "lender", "h", head.alias("head"), F.col("total").alias("own"), (
        head + F.greatest(F.col("total") - F.col("h"), F.lit(0))).alias("total")), "trie-rebuilt")
    own = base.with_counted(steps.turns.drop("total"), convs.select("conv", "h", "head", "own", "total"), ["conv"], "own")
    kept = own.filter("place > h").select(
        "conv", (F.col("part") + 1).alias("part"), (F.col("place") - F.col("h") + F.col("head")).alias("place"),
        "m", "chars", "total")
    # A lender's head has ``most`` rows, and fewer than 2 * every conversations borrow it.
    heads = steps.turns.filter((c % every == 0) & (F.col("place") <= most)).select(
        c.alias("lender"), "place", "m", "chars").join(convs, "lender").filter("place <= h").select(
        "conv", F.lit(0).alias("part"), "place", "m", "chars", "total")
    return Steps(base.stored(kept.unionByName(heads), "trie-steps"), convs.select("conv", "total"))


def members(steps: Steps) -> DataFrame:
    """One row per conversation and node that it passes, the root included: conv, depth, node (a, b), parent (pa, pb), chars, last."""
    a, b = (F.xxhash64(F.lit(salt), "place", "m") for salt in (1, 2))
    turns = steps.turns.withColumns({"ha": a, "hb": b})
    pieces = turns.groupBy("conv", "part").agg(F.bit_xor("ha").alias("pa"), F.bit_xor("hb").alias("pb"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("conv", "part", *[F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(c) for c in ("pa", "pb")])
    upto = Window.partitionBy("conv", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    keyed = turns.join(pieces, ["conv", "part"]).withColumns({
        "a": F.bit_xor("ha").over(upto).bitwiseXOR(F.col("pa")), "b": F.bit_xor("hb").over(upto).bitwiseXOR(F.col("pb"))})
    zero = F.lit(0).cast("bigint")
    roots = steps.convs.select("conv", zero.alias("depth"), zero.alias("a"), zero.alias("b"), zero.alias("pa"),
                               zero.alias("pb"), zero.alias("chars"), (F.col("total") == 0).alias("last"))
    return base.stored(keyed.select(
        "conv", F.col("place").cast("bigint").alias("depth"), "a", "b", F.col("a").bitwiseXOR(F.col("ha")).alias("pa"),
        F.col("b").bitwiseXOR(F.col("hb")).alias("pb"), "chars", (F.col("place") == F.col("total")).alias("last")).unionByName(
        roots), "trie-members")


NODE = ["depth", "a", "b"]


def nodes(passed: DataFrame, rest: int = tour.REST) -> DataFrame:
    """One row per node of the trie, from ``members``.

    conv_id (its smallest conversation), depth, a, b, parent_conv_id (null for
    the root), n_convs, n_ends (conversations that end there), n_children, n_leaves and saved_tokens (over
    its subtree, itself included: childless nodes, and code points of the last
    turn times the conversations but one), enter and exit (places in the tour).
    No conversations: no nodes, not even the root.
    """
    found = base.stored(passed.groupBy(*NODE).agg(
        F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if("last").alias("n_ends"),
        F.max("chars").alias("chars"), F.max("pa").alias("pa"), F.max("pb").alias("pb")).withColumn(
        "no", F.monotonically_increasing_id()), "trie-nodes")
    inner = found.filter("depth > 0").withColumn("up", F.col("depth") - 1)
    families = inner.groupBy("up", "pa", "pb").agg(F.count("*").alias("n_children"))
    parents = base.stored(families.join(found.select(
        F.col("depth").alias("up"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"),
        F.col("no").alias("parent")), ["up", "pa", "pb"]), "trie-parents")
    linked = base.stored(base.with_counted(inner, parents, ["up", "pa", "pb"], "n_children").drop("n_children").unionByName(
        found.filter("depth = 0"), allowMissingColumns=True).join(
        parents.select(F.col("parent").alias("no"), "n_children"), "no", "left").select(
        "no", "parent", F.col("conv_id").alias("place"), "conv_id", *NODE, "parent_conv_id", "n_convs", "n_ends",
        F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"),
        F.col("n_children").isNull().cast("bigint").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens")), "trie-linked")
    sums = tour.subtree_sums(linked, ["n_leaves", "saved_tokens"], rest)
    return linked.drop("place", "parent", "n_leaves", "saved_tokens").join(sums, "no").drop("no")


def prefix_trie(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                rest: int = tour.REST) -> DataFrame:
    """The trie of the conversations of a turn table; other columns are left alone."""
    return nodes(members(numbered(turns, conv, turn, role, text)), rest)


def digest(found: DataFrame, passed: DataFrame) -> DataFrame:
    """Nodes with ``ends_sha256``: of the ascending, comma-joined conversations that end there.

    A sha256 can't be split, so these ids of a node meet in one row here.
    """
    ends = passed.filter("last").groupBy(*NODE).agg(F.sha2(F.array_join(F.sort_array(
        F.collect_list("conv")).cast("array<string>"), ","), 256).alias("ends"))
    return found.join(ends, NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
