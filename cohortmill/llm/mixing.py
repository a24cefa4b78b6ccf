"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time 0..1. Its integral is the
source's share of all words; targets stop at ``max_repeat`` times the source and
the excess goes to the others by weight. The integral up to time t, times the
target, is the demand for the source's words until t. A source's documents
stand in a seeded order, so each copy of a document covers a range of the
source's cumulative words; inverting the cumulative demand at its start gives
its training position, and sorting by position gives the training order.

Running word counts are taken in 4,096 slices of the order per source, with the
totals of earlier slices added, so no source is counted in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortmill.llm import base

#: Hex digits of the order key that name a slice.
SLICE_DIGITS = 3


@dataclass(frozen=True)
class Schedule:
    """Piecewise linear weight: (time, weight) knots from time 0 to time 1, weights at least 0."""
    knots: tuple[tuple[float, float], ...]

    def areas(self) -> list[float]:
        """Integral up to each knot."""
        out = [0.0]
        for (t, w), (t2, w2) in zip(self.knots, self.knots[1:]):
            out.append(out[-1] + (t2 - t) * (w + w2) / 2)
        return out

    @property
    def weight(self) -> float:
        return self.areas()[-1]

    def invert(self, share: Column) -> Column:
        """The time by which ``share`` (0..1) of the integral is used up."""
        areas = self.areas()
        out = F.lit(float(self.knots[-1][0]))
        for i in reversed(range(len(self.knots) - 1)):
            (t, w), (t2, w2) = self.knots[i], self.knots[i + 1]
            rest = share * areas[-1] - F.lit(areas[i])
            root = F.sqrt(F.greatest(F.lit(0.0), F.lit(float(w * w)) + F.lit(2.0 * (w2 - w) / (t2 - t)) * rest))
            below = F.lit(float(w)) + root
            at = F.lit(float(t)) + F.when(below > 0, rest * 2.0 / below).otherwise(F.lit(0.0))
            out = F.when(share * areas[-1] < areas[i + 1], at).otherwise(out)
        return out


#: Weights 3, 1, 2: one that is used early, one late, one evenly.
SCHEDULES = (Schedule(((0.0, 4.5), (1.0, 1.5))), Schedule(((0.0, 0.5), (1.0, 1.5))), Schedule(((0.0, 2.0), (1.0, 2.0))))

RESULTS = ["size", "source_size", "target", "taken", "takes", "positions"]


def targets(sizes: DataFrame, schedules: tuple[Schedule, ...], share: float, max_repeat: float) -> DataFrame:
    """Adds ``class``, ``source_size`` and ``target`` to one row per source (source, size).

    Sources stand by code point, null last, and take the schedules in turn. A
    source is full if the level that is left for it and all later ones, by
    ascending limit per weight, reaches its limit; the rest share by weight.
    """
    everything = Window.partitionBy()
    n = len(schedules)
    weights = F.array(*[F.lit(s.weight) for s in schedules])
    ranked = sizes.withColumn(
        "class", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % n)
    limits = (ranked.withColumn("weight", F.element_at(weights, F.col("class") + 1))
              .withColumn("limit", F.col("size") * F.lit(float(max_repeat)))
              .withColumn("total", F.sum("size").over(everything) * F.lit(float(share)))
              .withColumn("weights", F.sum("weight").over(everything)))
    up = Window.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    levels = (limits.withColumn("room", F.col("total") - F.coalesce(F.sum("limit").over(before), zero))
              .withColumn("open", F.col("weights") - F.coalesce(F.sum("weight").over(before), zero))
              .withColumn("full", F.col("limit") * F.col("open") <= F.col("room") * F.col("weight")))
    level = F.min(F.when(~F.col("full"), F.struct((-F.col("open")).alias("o"), (F.col("room") / F.col("open")).alias("x")))
                  ).over(everything)["x"]
    return levels.withColumn("level", level).select(
        "source", "class", F.col("size").alias("source_size"),
        F.when(F.col("full"), F.col("limit")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def plan_mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
             schedules: tuple[Schedule, ...] = SCHEDULES, share: float = 1.5, max_repeat: float = 2.0,
             carry: list[str] | None = None) -> DataFrame:
    """All columns of ``docs`` (or those in ``carry``) and what the mix takes of each row.

    size: words of the text (null: 0). source_size, target: of its source.
    takes: words taken by each pass over the source, of which the last may stop
    inside a document; taken: their sum. positions: where the passes' copies
    stand, 0..1, null if nothing is taken. Input columns with these names are
    replaced. Null sources are a source of their own. Rows stand in the order
    of the md5 of their key and text, so reruns agree, and rows with a null or
    repeated key spread over the slices too; rows equal in both are
    interchangeable.
    """
    carried = [c for c in base.beside(docs, RESULTS) if carry is None or c in carry]
    passes = int(-(-max_repeat // 1))
    name = base.named(source)
    shaped = docs.select(
        F.struct(*[base.named(c) for c in carried]).alias("_row"),
        F.when(name.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), name.cast("string"))).alias("_group"),
        F.coalesce(F.regexp_count(base.named(text), F.lit(base.WORD)), F.lit(0)).cast("bigint").alias("_size"),
        F.md5(F.concat(F.coalesce(base.named(key).cast("string"), F.lit("")), F.lit(":"), F.coalesce(
            base.named(text).cast("string"), F.lit("")))).alias("_key")).withColumn("_slice", F.substring("_key", 1, SLICE_DIGITS))

    slices = base.stored(shaped.groupBy("_group", "_slice").agg(F.sum("_size").alias("_words")), "mix-slices")
    spelt = F.when(F.col("_group") != "n", F.substr("_group", F.lit(2))).alias("source")
    per_source = slices.groupBy("_group").agg(F.sum("_words").alias("size")).select(spelt, "size")
    stats = targets(per_source, schedules, share, max_repeat)
    group = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    offset = F.coalesce(F.sum("_words").over(
        Window.partitionBy("_group").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = slices.select("_group", "_slice", offset.alias("_before")).join(
        stats.select(group.alias("_group"), "class", "source_size", "target"), "_group")

    order = Window.partitionBy("_group", "_slice").orderBy("_key").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    placed = shaped.join(known, ["_group", "_slice"]).withColumn(
        "_start", F.col("_before") + F.sum("_size").over(order) - F.col("_size"))
    goal = F.floor("target")
    starts = [F.col("_start") + F.col("source_size") * i for i in range(passes)]
    takes = [F.greatest(F.lit(0), F.least(F.col("_size"), goal - s)) for s in starts]

    def position(start: Column) -> Column:
        used = start / F.col("target")
        out = schedules[-1].invert(used)
        for i in reversed(range(len(schedules) - 1)):
            out = F.when(F.col("class") == i, schedules[i].invert(used)).otherwise(out)
        return out

    return placed.select(
        "_row.*", F.col("_size").alias("size"), "source_size", "target",
        sum(takes[1:], takes[0]).cast("bigint").alias("taken"),
        F.array(*[t.cast("bigint") for t in takes]).alias("takes"),
        F.array(*[F.when(t > 0, position(s)) for s, t in zip(starts, takes)]).alias("positions"))


def training_order(plan: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per copy that the mix takes, sorted by training position.

    Adds position, copy (0: first pass) and words (how many the copy gives; the
    last of a source may be cut short), in place of the plan's columns.
    """
    carried = base.beside(plan, [*RESULTS, "position", "copy", "words"])
    copies = plan.select(
        F.struct(*[base.named(c) for c in carried]).alias("_row"),
        F.explode(F.filter(F.transform(F.arrays_zip("positions", "takes"), lambda x, i: F.struct(
            x["positions"].alias("position"), i.alias("copy"), x["takes"].alias("words"))),
            lambda x: x["words"] > 0)).alias("_copy"))
    return copies.select("_row.*", "_copy.position", "_copy.copy", "_copy.words").orderBy(
        "position", base.named(key), "copy")
