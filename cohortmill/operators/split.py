"""Group-disjoint stratified folds and fitted preprocessing constants."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from cohortmill.functions.columns import percent, share, sql_text, unit_hash
from cohortmill.operators.running import attach, exact_medians, row_numbers, same_keys
from cohortmill.session import materialize, written


def group_folds(df: DataFrame, group: str, label: str, folds: int = 5, seed: int = 42,
                size_cap: int = 3, prefix_chars: int = 3) -> DataFrame:
    """(group, rows, positives, stratum, fold): every group in exactly one fold.

    Rows without a group are left to ``with_split``.
    Groups are stratified by (has a positive, capped row count) and dealt to the
    folds in the order of a seeded md5. The position inside a stratum is a
    global row number, built from row numbers inside md5-prefix slices (evenly
    filled by nature of the hash) plus the slice offsets, so no stratum is
    sorted in one task.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(group).cast("string")))
    groups = df.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col(label) == 1).alias("positives"))
    stratum = (F.col("positives") > 0).cast("int") * 10 + F.least(F.col("rows"), F.lit(size_cap)).cast("int")
    placed = materialize(groups.select(group, "rows", "positives", stratum.alias("stratum"), digest.alias("digest"),
                                       F.substring(digest, 1, prefix_chars).alias("slice")))
    inside = Window.partitionBy("stratum", "slice").orderBy("digest", group)
    before = Window.partitionBy("stratum").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("stratum", "slice").agg(F.count(F.lit(1)).alias("n")).select(
        "stratum", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    numbered = placed.withColumn("rn", F.row_number().over(inside)).join(
        F.broadcast(offsets), ["stratum", "slice"])
    return numbered.select(group, "rows", "positives", "stratum",
                           ((F.col("offset") + F.col("rn") - 1) % folds).cast("int").alias("fold"))


def deal(load: list[int], second: list[int], item: int, n: int) -> list[int]:
    """How many of n equal items each fold gets, always the least loaded first; ``load`` is updated.

    Items go in bulk, so the work follows the folds and not the items.
    """
    folds, out = len(load), [0] * len(load)
    while n:
        order = sorted(range(folds), key=lambda f: (load[f], second[f], f))
        if load[order[-1]] - load[order[0]] <= item and n >= folds:
            each = n // folds
            for f in range(folds):
                out[f], load[f] = out[f] + each, load[f] + each * item
            n -= each * folds
            continue
        f = order[0]
        short = load[order[1]] - load[f] if folds > 1 else n * item
        k = min(n, max(1, short // item))
        out[f], load[f], n = out[f] + k, load[f] + k * item, n - k
    return out


def pack(types: list[tuple[int, int, int]], folds: int) -> dict[tuple[int, int], list[int]]:
    """Per type (rows, positives) with its number of groups: how many of them each fold gets.

    Largest first: groups with positives even out the positives, then groups
    without even out the rows.
    """
    rows, positives = [0] * folds, [0] * folds
    out: dict[tuple[int, int], list[int]] = {}
    for size, pos, n in sorted((t for t in types if t[1]), key=lambda t: (-t[1], -t[0])):
        out[size, pos] = deal(positives, rows, pos, n)
        rows = [r + size * k for r, k in zip(rows, out[size, pos])]
    for size, pos, n in sorted((t for t in types if not t[1]), key=lambda t: -t[0]):
        out[size, pos] = deal(rows, positives, size, n)
    return out


def packed_folds(df: DataFrame, group: str, label: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """(group, rows, positives, fold): every group in one fold, with folds balanced on positives and on rows.

    Groups are reduced to types (rows, positives), of which n rows have at most
    about n^(2/3); how many groups of a type each fold gets is packed on the
    driver. Positives of two folds differ by at most the most positives of a
    group, and so do rows by the largest group, where groups without positives
    can make up for what those with positives leave uneven. Which groups of a
    type go where follows a seeded md5.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(group).cast("string")))
    groups = written(df.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col(label) == 1).alias("positives")).withColumn("__digest", digest))
    types = [(r["rows"], r["positives"], r["n"]) for r in
             groups.groupBy("rows", "positives").agg(F.count(F.lit(1)).alias("n")).collect()]
    plan = [(*key, [sum(counts[:f + 1]) for f in range(folds)]) for key, counts in pack(types, folds).items()]
    planned = df.sparkSession.createDataFrame(plan, "rows bigint, positives bigint, upto array<bigint>")
    numbered = row_numbers(groups, ["rows", "positives"], ["__digest", group])
    placed = attach(numbered, planned, ["rows", "positives"])
    return placed.select(group, "rows", "positives", F.size(F.filter("upto", lambda u: u < F.col("rn"))).alias("fold"))


def split_name(fold: Column) -> Column:
    """Fold 0 tests, fold 1 validates, the others train."""
    return F.when(fold == 0, "test").when(fold == 1, "validation").otherwise("train")


def with_split(df: DataFrame, folds: DataFrame, group: str, key: str | None = None, count: int = 5,
               seed: int = 42) -> DataFrame:
    """Add the split of each row's group; no row is lost.

    A row without a group (null, or not among the folds) stands alone: a hash of
    its ``key``, by default of all its columns, gives its fold.
    """
    own = F.floor(unit_hash(F.lit(str(seed)), *[F.col(c).cast("string") for c in ([key] if key else df.columns)]) * count)
    placed = df.join(folds.select(group, F.col("fold").alias("__fold")), group, "left")
    return placed.withColumn("split", split_name(F.coalesce(F.col("__fold"), own.cast("int")))).drop("__fold")


def lookup_group(df: DataFrame, entities: DataFrame, key: str, group: str) -> DataFrame:
    """Add the group of each row's entity; a missing entity gives null, not an error."""
    if group in df.columns:
        return df
    return df.join(entities.select(key, group), key, "left")


def split_summary(df: DataFrame, group: str, label: str) -> DataFrame:
    """Per split: rows, groups, positives, rate; a row without a group is a group of its own."""
    per_group = df.groupBy("split", group).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("pos"))
    return per_group.groupBy("split").agg(
        F.sum("n").alias("stays"),
        F.sum(F.when(F.col(group).isNull(), F.col("n")).otherwise(1)).alias("persons"), F.sum("pos").alias("positives"),
        (F.sum("pos") / F.sum("n")).alias("positive_rate"))


def split_overlap(df: DataFrame, group: str) -> DataFrame:
    """Groups shared by each pair of splits; all zero for a valid split."""
    per_group = df.where(F.col(group).isNotNull()).groupBy(group).agg(*[
        F.bool_or(F.col("split") == s).alias(s) for s in ("train", "validation", "test")])
    pairs = (("train", "validation"), ("train", "test"), ("validation", "test"))
    row = per_group.agg(*[F.count_if(F.col(a) & F.col(b)).alias(f"{a}_{b}") for a, b in pairs])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(f"{a}-{b}").alias("pair"), F.col(f"{a}_{b}").alias("shared_persons")) for a, b in pairs])))


def require_disjoint(df: DataFrame, group: str) -> None:
    shared = split_overlap(df, group).agg(F.sum("shared_persons")).first()[0]
    if shared:
        raise ValueError(f"{shared} groups occur in more than one split")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (2 n_c) and the negative-to-positive ratio."""
    n, pos, neg = F.count(F.lit(1)), F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return df.agg(n.alias("n"), pos.alias("n_pos"), neg.alias("n_neg"),
                  share(n, 2.0 * pos).alias("weight_pos"), share(n, 2.0 * neg).alias("weight_neg"),
                  share(neg, pos).alias("scale_pos_weight"))


@dataclass(frozen=True)
class Encoder:
    """Constants fitted on the training rows: bounded by columns and levels."""

    medians: dict[str, float]
    means: dict[str, float] = field(default_factory=dict)
    stds: dict[str, float] = field(default_factory=dict)
    levels: dict[str, list[str]] = field(default_factory=dict)
    unknown: str = "Unknown"

    @property
    def names(self) -> list[str]:
        """Encoded feature names in vector order."""
        return [*self.medians, *[f"{c}_{v}" for c, vs in self.levels.items() for v in vs]]

    def imputed(self, name: str) -> str:
        """SQL text of the imputed column."""
        return f"coalesce(cast(`{name}` as double), {self.medians[name]!r}D)"

    def columns(self) -> list[Column]:
        """Imputed, standardised and one-hot columns; unseen levels are all zeros."""
        out = []
        for c in self.medians:
            mean, scale = self.means.get(c, 0.0), self.stds.get(c, 1.0) or 1.0
            out.append(F.expr(f"({self.imputed(c)} - {mean!r}D) / {scale!r}D as `{c}`"))
        for c, values in self.levels.items():
            level = f"coalesce(cast(`{c}` as string), {sql_text(self.unknown)})"
            out += [F.expr(f"case when {level} = {sql_text(v)} then 1.0D else 0.0D end").alias(f"{c}_{v}") for v in values]
        return out

    def encode(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """``keep`` columns and the ``features`` vector, sparse where that is smaller.

        Levels are looked up in a map, so their number adds no columns.
        """
        numbers = [f"__x{i}" for i in range(len(self.medians))]
        listed = [c for c, values in self.levels.items() if values]
        texts, places, hots = ([f"__{p}{i}" for i in range(len(listed))] for p in "tph")
        wide = df.select(*keep, *[c.alias(s) for c, s in zip(self.columns(), numbers)], *[
            F.coalesce(F.col(c).cast("string"), F.lit(self.unknown)).alias(t) for c, t in zip(listed, texts)])
        if listed:
            # An unseen level gets the place after the last, which the one-hot form drops.
            for c, text, place in zip(listed, texts, places):
                wide = StringIndexerModel.from_labels(self.levels[c], text, place, handleInvalid="keep").transform(wide)
            wide = OneHotEncoder(inputCols=places, outputCols=hots, dropLast=True).fit(wide).transform(wide)
        out = VectorAssembler(inputCols=[*numbers, *hots], outputCol="features").transform(wide).select(*keep, "features")
        # Without attributes, so that trees split every feature by a threshold.
        return out.withMetadata("features", {})

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [("median", c, None, v) for c, v in self.medians.items()]
        rows += [("mean", c, None, v) for c, v in self.means.items()]
        rows += [("std", c, None, v) for c, v in self.stds.items()]
        rows += [("level", c, v, None) for c, vs in self.levels.items() for v in vs]
        rows.append(("unknown", None, self.unknown, None))
        ordered = [(i, *r) for i, r in enumerate(rows)]
        spark.createDataFrame(ordered, "position int, kind string, feature string, level string, value double") \
            .coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Encoder":
        """Read back the constants (one small row per column or level)."""
        rows = spark.read.parquet(path).orderBy("position").collect()
        parts: dict[str, dict] = {"median": {}, "mean": {}, "std": {}, "level": {}}
        unknown = "Unknown"
        for r in rows:
            if r["kind"] == "unknown":
                unknown = r["level"]
            elif r["kind"] == "level":
                parts["level"].setdefault(r["feature"], []).append(r["level"])
            else:
                parts[r["kind"]][r["feature"]] = r["value"]
        return Encoder(parts["median"], parts["mean"], parts["std"], parts["level"], unknown)


def split_types(df: DataFrame, columns: list[str]) -> tuple[list[str], list[str]]:
    """(numeric, categorical) columns by schema type."""
    numeric = [c for c in columns if isinstance(df.schema[c].dataType, T.NumericType)]
    return numeric, [c for c in columns if c not in numeric]


def moments_after_imputing(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    """One row of means and population standard deviations of the imputed columns."""
    parts = []
    for c, m in medians.items():
        value = f"coalesce(cast(`{c}` as double), {float(m)!r}D)"
        parts += [F.expr(f"avg({value}) as `mean_{c}`"), F.expr(f"stddev_pop({value}) as `std_{c}`")]
    return df.agg(*parts)


def fit_encoder(train: DataFrame, numeric: list[str], categorical: list[str], unknown: str = "Unknown") -> Encoder:
    """Fit medians, scaling and levels on the training rows.

    Only constants reach the driver: one number per column and one row per
    category level. They are the names of the encoded features.
    """
    found = {r["feature"]: r["q0"] for r in exact_medians(train, numeric).collect()} if numeric else {}
    medians = {c: float(found[c]) if found.get(c) is not None else 0.0 for c in numeric}
    means, stds = {}, {}
    if numeric:
        row = moments_after_imputing(train, medians).first()
        means = {c: float(row[f"mean_{c}"] or 0.0) for c in numeric}
        stds = {c: float(row[f"std_{c}"] or 0.0) or 1.0 for c in numeric}
    levels: dict[str, list[str]] = {}
    if categorical:
        long = train.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("c"), F.coalesce(F.col(c).cast("string"), F.lit(unknown)).alias("v"))
            for c in categorical]))).distinct()
        rows = long.collect()
        for c in categorical:
            levels[c] = sorted(r["v"] for r in rows if r["c"] == c)
    return Encoder(medians, means, stds, levels, unknown)
