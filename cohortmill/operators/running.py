"""Global running totals and exact quantiles without a one-task window.

A window without a partition key sorts the whole table in one task. Here a
table holding one row per distinct value is cut into value ranges of about
equal row count; each range is summed on its own, and the totals of the ranges
before it (one row per group and range) are added.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortmill.functions.columns import sql_text
from cohortmill.session import materialize, written

BUCKET = "__range"
ROWS_PER_RANGE = 500_000


def range_edges(df: DataFrame, order: str, rows_per_range: int = ROWS_PER_RANGE) -> list[float]:
    """Inner edges of equal-frequency ranges, as many as the rows ask for; [] when one range is enough.

    Reads a compact, materialised table. The edges only decide how the work is
    split, so that they are approximate does not touch the result.
    """
    wanted = -(-df.count() // rows_per_range)
    if wanted <= 1:
        return []
    probabilities = [i / wanted for i in range(1, wanted)]
    cuts = df.agg(F.percentile_approx(F.col(order).cast("double"), probabilities, 4 * wanted)).first()[0]
    return sorted(set(cuts or []))


def assign_range(df: DataFrame, order: str, edges: list[float]) -> DataFrame:
    """Add the range number, a monotone function of ``order``."""
    if not edges:
        return df.withColumn(BUCKET, F.lit(0))
    splits = [float("-inf"), *edges, float("inf")]
    cast = df.withColumn("__order", F.col(order).cast("double"))
    out = Bucketizer(splits=splits, inputCol="__order", outputCol="__r").transform(cast)
    return out.withColumn(BUCKET, F.col("__r").cast("int")).drop("__order", "__r")


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join that also matches null keys; keeps the left key columns."""
    renamed = right.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    condition = None
    for key in keys:
        part = F.col(key).eqNullSafe(F.col(f"__k_{key}"))
        condition = part if condition is None else condition & part
    return left.join(renamed, condition, how).drop(*[f"__k_{k}" for k in keys])


def attach(rows: DataFrame, per_group: DataFrame, keys: list[str]) -> DataFrame:
    """Add a per-group table to many rows without moving the rows.

    Few groups would mean few, huge partitions in a shuffled join. The group
    table is written first, so Spark knows its bytes and broadcasts it below
    ``spark.sql.autoBroadcastJoinThreshold``. Only with more groups than that,
    when the key spreads well, is it shuffled. Without keys it is one row and
    broadcast as it is.
    """
    if not keys:
        return rows.join(F.broadcast(per_group))
    return same_keys(rows, written(per_group), keys, "inner")


def running_totals(df: DataFrame, by: list[str], order: str, totals: dict[str, Column],
                   descending: bool = False, rows_per_range: int = ROWS_PER_RANGE,
                   edges: list[float] | None = None) -> DataFrame:
    """Add inclusive running sums of ``totals`` over ``order`` inside each group.

    ``df`` holds one row per (by, order) and is read more than once, so pass a
    materialised table. If it already carries range numbers (with their
    ``edges``) and is laid out by them, it is not moved again.
    """
    if edges is None:
        edges = range_edges(df, order, rows_per_range)
    ranged = df if BUCKET in df.columns else assign_range(df, order, edges)
    key = F.col(order).desc() if descending else F.col(order).asc()
    inside = (Window.partitionBy(*by, BUCKET).orderBy(key)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = ranged.withColumns({name: F.sum(value).over(inside) for name, value in totals.items()})
    if not edges:
        return local.drop(BUCKET)

    sums = ranged.groupBy(*by, BUCKET).agg(*[F.sum(v).alias(f"__s_{n}") for n, v in totals.items()])
    step = F.col(BUCKET).desc() if descending else F.col(BUCKET).asc()
    before = Window.partitionBy(*by).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *by, BUCKET,
        *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in totals])
    return attach(local, offsets, [*by, BUCKET]).withColumns(
        {n: F.col(n) + F.col(f"__b_{n}") for n in totals}
    ).drop(BUCKET, *[f"__b_{n}" for n in totals])


def row_numbers(df: DataFrame, keys: list[str], order: list[str], output: str = "rn") -> DataFrame:
    """Add the row number (from 1) within each key, though one key may hold most of the rows.

    Rows are laid out in ranges of (keys, order) and written; numbers inside a
    range continue after those of the key's earlier ranges. ``order`` should
    tell the rows of a key apart.
    """
    laid = written(df.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = laid.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n")).withColumn(
        "__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = Window.partitionBy(*keys, "__part").orderBy(*order)
    joined = same_keys(laid, pieces, [*keys, "__part"], "inner")
    return joined.withColumn(output, F.col("__before") + F.row_number().over(inside)).drop("__part", "__before")


def value_counts_table(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Materialised (by, value, copies) for the non-null values."""
    counted = (df.where(F.col(value).isNotNull())
               .groupBy(*by, F.col(value).cast("double").alias("value"))
               .agg(F.count(F.lit(1)).alias("copies")))
    return materialize(counted)


def exact_quantiles(df: DataFrame, value: str, probabilities: list[float], by: list[str] | None = None,
                    rows_per_range: int = ROWS_PER_RANGE, narrow: bool = False) -> DataFrame:
    """Exact linearly interpolated quantiles per group, columns ``q0, q1, ...``.

    Equal values are merged before the shuffle, so a value shared by a third of
    the rows is one row here. ``narrow`` reads the rows twice more but shuffles
    only the values near the wanted ranks: worth it when most values differ.
    Also returns ``n``, the number of values.
    """
    by = by or []
    present = df.where(F.col(value).isNotNull())
    if narrow:
        present, sizes = near_ranks(present, value, probabilities, by)
    counts = value_counts_table(present, by, value)
    if not narrow:
        sizes = counts.groupBy(*by).agg(F.sum("copies").alias("n"), *[
            F.lit(0).cast("bigint").alias(f"__skip{i}") for i in range(len(probabilities))])
    return quantiles_of_counts(counts, sizes, probabilities, by, rows_per_range)


def quantiles_of_counts(counts: DataFrame, sizes: DataFrame, probabilities: list[float], by: list[str],
                        rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Quantiles from (by, value, copies) and per group n and the ranks that were left out below (``__skip{i}``)."""
    ranked = running_totals(counts, by, "value", {"upto": F.col("copies")}, rows_per_range=rows_per_range)
    ranked = attach(ranked, sizes, by)
    picks, outs = [], []
    for i, q in enumerate(probabilities):
        position = (F.col("n") - 1) * F.lit(float(q))
        upto = F.col("upto") + F.col(f"__skip{i}")
        for side, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            holds = (upto - F.col("copies") <= rank) & (rank < upto)
            picks.append(F.max(F.when(holds, F.col("value"))).alias(f"__{side}{i}"))
        picks.append(F.max(position - F.floor(position)).alias(f"__t{i}"))
        outs.append((F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * F.col(f"__t{i}")).alias(f"q{i}"))
    return ranked.groupBy(*by, "n").agg(*picks).select(*by, "n", *outs)


#: Values per unit of accuracy below which brackets are not trusted.
WHOLE = 3


def near_ranks(df: DataFrame, value: str, probabilities: list[float], by: list[str],
               accuracy: int = 2000) -> tuple[DataFrame, DataFrame]:
    """Rows whose value can hold a wanted rank, and per group n and the skipped counts.

    An approximate quantile is off by at most n / accuracy ranks, so the values
    between the approximate quantiles two such steps below and above enclose
    the wanted ranks. ``__skip{i}`` is what must be added to a rank among the
    kept rows to get the rank among all rows, valid inside bracket i. In groups
    of fewer than ``WHOLE`` times accuracy values, where a step is less than a
    few ranks and a bracket may end before the rank above, all rows are kept.
    """
    v = F.col(value).cast("double")
    margin = 2.0 / accuracy
    edges = [e for q in probabilities for e in (max(0.0, q - margin), min(1.0, q + margin))]
    sketch = df.groupBy(*by).agg(F.percentile_approx(v, edges, accuracy).alias("__e"), F.count(v).alias("__m"))
    marked = attach(df.select(*by, v.alias(value)), sketch, by)
    pairs = range(len(probabilities))
    low = [F.element_at("__e", 2 * i + 1) for i in pairs]
    high = [F.element_at("__e", 2 * i + 2) for i in pairs]
    kept = F.col("__m") < WHOLE * accuracy
    for i in pairs:
        kept = kept | F.col(value).between(low[i], high[i])
    kept = F.col(value).isNotNull() & kept
    sizes = marked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[
        (F.count_if(F.col(value) < low[i]) - F.count_if((F.col(value) < low[i]) & kept)).alias(f"__skip{i}") for i in pairs])
    return marked.where(kept).select(*by, value), sizes


def wide_quantiles(df: DataFrame, columns: list[str], probabilities: list[float], accuracy: int = 2000) -> DataFrame:
    """(feature, n, q0, q1, ...): exact quantiles of every column with a value, all columns together.

    One wide pass brackets every wanted rank, a second counts what lies below
    each bracket, and only the values inside are unpivoted, shuffled and ranked.
    Brackets and counts are a few numbers per column. Pass a table that is cheap
    to read column by column.
    """
    wanted = range(len(probabilities))
    empty = "feature string, n bigint, " + ", ".join(f"q{i} double" for i in wanted)
    if not columns:
        return df.sparkSession.createDataFrame([], empty)
    cast = {c: F.expr(f"cast(`{c}` as double)") for c in columns}
    margin = 2.0 / accuracy
    ends = [e for q in probabilities for e in (max(0.0, q - margin), min(1.0, q + margin))]
    found = df.agg(*[f for i, v in enumerate(cast.values()) for f in (
        F.percentile_approx(v, ends, accuracy).alias(f"e{i}"), F.count(v).alias(f"m{i}"))]).first()
    whole = {c for i, c in enumerate(columns) if found[f"m{i}"] < WHOLE * accuracy}
    edges = {c: found[f"e{i}"] for i, c in enumerate(columns) if found[f"e{i}"] is not None}
    if not edges:
        return df.sparkSession.createDataFrame([], empty)

    def inside(c: str) -> Column:
        kept = F.lit(c in whole)
        for i in wanted:
            kept = kept | cast[c].between(F.lit(edges[c][2 * i]), F.lit(edges[c][2 * i + 1]))
        return kept

    below = lambda c, i: cast[c] < F.lit(edges[c][2 * i])
    row = df.agg(*[f for j, c in enumerate(edges) for f in (F.count(cast[c]).alias(f"n{j}"), *[
        F.count_if(below(c, i) & ~inside(c)).alias(f"s{j}_{i}") for i in wanted])]).first()
    sizes = df.sparkSession.createDataFrame(
        [(c, row[f"n{j}"], *[row[f"s{j}_{i}"] for i in wanted]) for j, c in enumerate(edges)],
        "feature string, n bigint, " + ", ".join(f"__skip{i} bigint" for i in wanted))
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.when(inside(c), cast[c]).alias("v")) for c in edges])
    counts = value_counts_table(df.select(F.inline(cells)), ["feature"], "v")
    return quantiles_of_counts(counts, sizes, probabilities, ["feature"])


def exact_medians(df: DataFrame, columns: list[str], accuracy: int = 2000) -> DataFrame:
    """(feature, n, q0): exact median of every column with a value."""
    return wide_quantiles(df, columns, [0.5], accuracy)
