"""Feature attributions of tree and linear models, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortmill import presets
from cohortmill.operators.trees import tree_shap_rows


def zipped(names: list[str]) -> Column:
    """The arrays of an attributed row as structs (feature, feature_value, shap_value)."""
    labels = F.split(F.lit("\x1f".join(names)), "\x1f")
    return F.arrays_zip(labels.alias("feature"), F.col("feature_values").alias("feature_value"),
                        F.col("shap_values").alias("shap_value"))


def long_contributions(rows: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Long table (key, base_value, feature, feature_value, shap_value)."""
    return rows.select(key, "base_value", F.inline(zipped(names)))


def tree_shap(df: DataFrame, key: str, leaves: DataFrame, names: list[str]) -> DataFrame:
    """Long attributions of a tree model's leaf table."""
    return long_contributions(tree_shap_rows(df, key, leaves), key, names)


def local_from_rows(rows: DataFrame, key: str, names: list[str], k: int = 5) -> DataFrame:
    """Per entity: base, sum, margin and top contributions, computed inside the row (no shuffle)."""
    def top(sign: float) -> Column:
        kept = F.filter(zipped(names), lambda e: e["shap_value"] * sign > 0)
        ordered = F.array_sort(F.transform(kept, lambda e: F.struct(
            (-F.abs(e["shap_value"])).alias("order"), e["feature"].alias("feature"),
            e["feature_value"].alias("feature_value"), e["shap_value"].alias("shap_value"))))
        return F.transform(F.slice(ordered, 1, k), lambda e: F.struct(
            e["feature"].alias("feature"), e["feature_value"].alias("feature_value"), e["shap_value"].alias("shap_value")))

    total = F.aggregate("shap_values", F.lit(0.0), lambda a, v: a + v)
    return rows.select(key, "base_value", total.alias("total_shap"), (F.col("base_value") + total).alias("margin"),
                       top(1.0).alias("top_increasing"), top(-1.0).alias("top_decreasing"))


def linear_contributions(df: DataFrame, key: str, weights: dict[str, float], means: dict[str, float]) -> DataFrame:
    """Closed-form attributions w * (x - mean) of a linear model; null values contribute 0."""
    return df.select(key, F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("feature_value"),
                 F.coalesce(F.lit(float(w)) * (F.col(c) - F.lit(float(means[c]))), F.lit(0.0)).alias("shap_value"))
        for c, w in weights.items()])))


# --- summaries of a long attribution table -----------------------------------------

def global_importance(contributions: DataFrame) -> DataFrame:
    """Mean absolute attribution, its share and the running share per feature.

    The windows run over one row per feature.
    """
    mean_abs = contributions.groupBy("feature").agg(F.avg(F.abs("shap_value")).alias("mean_abs_shap"))
    everything = Window.partitionBy(F.lit(0))
    order = everything.orderBy(F.desc("mean_abs_shap"), "feature").rowsBetween(Window.unboundedPreceding, 0)
    share = 100.0 * F.col("mean_abs_shap") / F.nullif(F.sum("mean_abs_shap").over(everything), F.lit(0.0))
    return (mean_abs.withColumn("relative_pct", share)
            .withColumn("cumulative_pct", F.sum("relative_pct").over(order))
            .withColumn("rank", F.row_number().over(everything.orderBy(F.desc("mean_abs_shap"), "feature"))))


def signed_top(contributions: DataFrame, key: str, k: int) -> DataFrame:
    """(key, direction, rank, feature, feature_value, shap_value): k largest per sign.

    Attributions of one entity are as many as there are features, so the
    per-entity window stays small.
    """
    direction = F.when(F.col("shap_value") > 0, "increase").when(F.col("shap_value") < 0, "decrease")
    signed = contributions.withColumn("direction", direction).where(F.col("direction").isNotNull())
    w = Window.partitionBy(key, "direction").orderBy(F.desc(F.abs("shap_value")), "feature")
    return signed.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        key, "direction", "rank", "feature", "feature_value", "shap_value")


def local_contributions(contributions: DataFrame, key: str, k: int = 5, base: str = "base_value") -> DataFrame:
    """Per entity: base, sum, margin and the top contributions of each sign as arrays."""
    item = F.struct((-F.abs("shap_value")).alias("order"), "feature", "feature_value", "shap_value")

    def top(condition: Column) -> Column:
        kept = F.slice(F.array_sort(F.collect_list(F.when(condition, item))), 1, k)
        return F.transform(kept, lambda e: F.struct(
            e["feature"].alias("feature"), e["feature_value"].alias("feature_value"), e["shap_value"].alias("shap_value")))

    return contributions.groupBy(key).agg(
        F.max(base).alias("base_value"), F.sum("shap_value").alias("total_shap"),
        (F.max(base) + F.sum("shap_value")).alias("margin"),
        top(F.col("shap_value") > 0).alias("top_increasing"), top(F.col("shap_value") < 0).alias("top_decreasing"))


def driver_text(contributions: DataFrame, key: str, k: int = 3) -> DataFrame:
    """Names of the k strongest features per direction, joined by commas."""
    top = signed_top(contributions, key, k)

    def names(direction: str) -> Column:
        chosen = F.collect_list(F.when(F.col("direction") == direction, F.struct("rank", "feature")))
        return F.array_join(F.transform(F.array_sort(chosen), lambda e: e["feature"]), ", ")

    return top.groupBy(key).agg(names("increase").alias("increasing"), names("decrease").alias("decreasing"))


def driver_names(local: DataFrame, key: str, k: int = 3) -> DataFrame:
    """The same from the arrays of ``local_from_rows``, inside the row."""
    def names(top: str) -> Column:
        return F.array_join(F.transform(F.slice(top, 1, k), lambda e: e["feature"]), ", ")

    return local.select(key, names("top_increasing").alias("increasing"), names("top_decreasing").alias("decreasing"))


def case_studies(df: DataFrame, key: str, y: str, p: str, threshold: float) -> DataFrame:
    """The extreme entity of each confusion quadrant; an empty quadrant has no row.

    Highest score among the flagged, lowest among the others; ties go to the
    smallest key. One aggregation, no window.
    """
    flagged, positive = F.col(p) >= threshold, F.col(y) == 1
    quadrant = (F.when(positive & flagged, "TP").when(~positive & ~flagged, "TN")
                .when(~positive & flagged, "FP").when(positive & ~flagged, "FN"))
    order = F.when(flagged, -F.col(p)).otherwise(F.col(p))
    return (df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
            .groupBy(quadrant.alias("quadrant"))
            .agg(F.min(F.struct(order.alias("o"), F.col(key).alias("k"), F.col(p).alias("p"), F.col(y).alias("y"))).alias("c"))
            .select("quadrant", F.col("c.k").alias(key), F.col("c.p").alias("probability"),
                    F.when(F.col("c.y") == 1, "Deceased").otherwise("Survived").alias("actual_outcome")))


def with_metadata(cases: DataFrame, entities: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Add entity columns to the case studies, of which there are at most four."""
    known = entities.select(key, *columns).join(F.broadcast(cases.select(key).distinct()), key)
    return cases.join(known, key, "left").select(key, *columns, *[c for c in cases.columns if c != key])


# --- display names -----------------------------------------------------------------

def display_name(column: Column) -> Column:
    """Readable feature name; the first rule that matches wins.

    Category prefix, exact name, measurement prefix with statistic suffix, else
    title case.
    """
    name = F.replace(F.replace(column, F.lit("num__"), F.lit("")), F.lit("cat__"), F.lit(""))
    out: Column | None = None

    def rule(condition: Column, value: Column) -> None:
        nonlocal out
        out = F.when(condition, value) if out is None else out.when(condition, value)

    for prefix, text in presets.CATEGORY_LABELS.items():
        rule(name.startswith(f"{prefix}_"),
             F.concat(F.lit(f"{text}: "), F.replace(name, F.lit(f"{prefix}_"), F.lit(""))))
    for exact, text in presets.EXACT_LABELS.items():
        rule(name == exact, F.lit(text))
    for prefix, text in presets.MEASURE_LABELS.items():
        suffix = F.substring(name, F.lit(len(prefix) + 2), F.length(name))
        known: Column | None = None
        for stat, shown in presets.STATISTIC_LABELS.items():
            known = F.when(suffix == stat, shown) if known is None else known.when(suffix == stat, shown)
        other = F.concat(F.upper(F.substring(suffix, 1, 1)), F.lower(F.substring(suffix, F.lit(2), F.length(suffix))))
        rule(name.startswith(f"{prefix}_"), F.concat(F.lit(f"{text} ("), known.otherwise(other), F.lit(")")))
    return out.otherwise(F.initcap(F.replace(name, F.lit("_"), F.lit(" "))))
