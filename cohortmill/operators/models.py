"""Model families, grids, calibrators and model choice on Spark ML."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark import SparkContext
from pyspark.ml.classification import GBTClassifier, LogisticRegression, LogisticRegressionModel, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.common import _py2java
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, functions as F

from cohortmill import presets
from cohortmill.functions.columns import clip, share, sigmoid
from cohortmill.operators import boosting, forest, logistic as logistic_steps
from cohortmill.operators.boosting import BoostedTrees, Setting
from cohortmill.operators.curves import (
    auroc_column, average_precision_column, binary_metrics, bin_of, bin_table, calibration_error,
    counts_at, max_f1_threshold, metrics_from_ranked, score_counts, squared_error_column, uniform_edges,
)
from cohortmill.operators.isotonic import fit_isotonic  # noqa: F401
from cohortmill.operators.running import running_totals, same_keys
from cohortmill.operators.split import class_weights
from cohortmill.session import checkpoint_dir, materialize, written

LABEL, WEIGHT, FEATURES = "label", "weight", "features"


@dataclass(frozen=True)
class Fitted:
    """A fitted candidate: family, its settings and the Spark ML model."""

    family: str
    name: str
    params: dict[str, Any]
    model: Any


def balanced(df: DataFrame, label: str) -> tuple[DataFrame, dict[str, float]]:
    """Training rows with label, balanced weight and features; and the class sizes."""
    row = class_weights(df, label).first().asDict()
    weight = F.when(F.col(label) == 1, F.lit(row["weight_pos"])).otherwise(F.lit(row["weight_neg"]))
    return df.select(F.col(label).cast("double").alias(LABEL), weight.alias(WEIGHT), FEATURES), row


#: Least partitions of the training rows, and rows in one. Bagging draws per partition, so these are
#: parameters of the fit: the rows alone decide, and give one model on every cluster.
FIT_PARTITIONS, ROWS_PER_PARTITION = 4, 16_384


def training_rows(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Materialised training rows in a layout that depends on the rows alone, not on how they arrive."""
    if partitions is None:
        partitions = max(FIT_PARTITIONS, -(-df.count() // ROWS_PER_PARTITION))
    others = [c for c in df.columns if c != FEATURES]
    place = F.xxhash64(vector_to_array(F.col(FEATURES)), *others)
    laid = df.withColumn("__place", place).repartition(partitions, "__place").sortWithinPartitions("__place", *others)
    return materialize(laid.drop("__place"))


def run_parallel(jobs: Sequence[Callable[[], Any]], parallelism: int) -> list[Any]:
    """Independent fits submitted from driver threads; each fit is distributed."""
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        return [f.result() for f in [pool.submit(job) for job in jobs]]


def logistic(c: float, weight_sum: float) -> LogisticRegression:
    """L2 logistic regression; 1/(C * sum of weights) is the penalty per unit of weight."""
    return LogisticRegression(featuresCol=FEATURES, labelCol=LABEL, weightCol=WEIGHT, elasticNetParam=0.0,
                              regParam=1.0 / (c * weight_sum), standardization=False, maxIter=1000, tol=1e-8)


def logistic_model(estimator: LogisticRegression, rows: DataFrame, beta: np.ndarray, objectives: list[float]) -> LogisticRegressionModel:
    """Spark's model of given coefficients and, last, the intercept, with the summary that its fit would add."""
    context = SparkContext._active_spark_context
    classes = context._jvm.org.apache.spark.ml.classification

    def of(coefficients: Any) -> LogisticRegressionModel:
        found = estimator._copyValues(LogisticRegressionModel(
            classes.LogisticRegressionModel(estimator.uid, coefficients, float(beta[-1]))))
        found._transfer_params_to_java()
        return found

    coefficients = _py2java(context, Vectors.dense(beta[:-1]))
    model, scoring = of(coefficients), of(coefficients)
    history = context._gateway.new_array(context._jvm.double, len(objectives))
    for i, v in enumerate(objectives):
        history[i] = v
    summary = classes.BinaryLogisticRegressionTrainingSummaryImpl(
        scoring._java_obj.transform(rows._jdf), scoring.getProbabilityCol(), scoring.getPredictionCol(), LABEL, FEATURES, WEIGHT, history)
    model._java_obj.setSummary(context._jvm.scala.Some(summary))
    return model


def fit_logistic_grid(train: DataFrame, label: str, grid=presets.LOGISTIC_GRID, parallelism: int = 8) -> list[Fitted]:
    """All settings step by step from shared scans; training rows of one class are left to Spark's own fit."""
    rows, sizes = balanced(train, label)
    rows = training_rows(rows)
    if sizes["n_pos"] and sizes["n_neg"]:
        betas, history = logistic_steps.fit(rows, LABEL, WEIGHT, FEATURES, grid)
        fits = [logistic_model(logistic(c, sizes["n"]), rows, betas[i], history[i]) for i, c in enumerate(grid)]
    else:
        fits = run_parallel([lambda c=c: logistic(c, sizes["n"]).fit(rows) for c in grid], parallelism)
    return [Fitted("logistic", f"logistic_{i}", {"C": c}, m) for i, (c, m) in enumerate(zip(grid, fits))]


def fit_forest_grid(train: DataFrame, label: str, grid=presets.FOREST_GRID, seed: int = 42,
                    parallelism: int = 8) -> list[Fitted]:
    """Random forests, grown together; the smallest leaf stands in for the smallest splittable node."""
    rows, sizes = balanced(train, label)
    rows = training_rows(rows)
    spark, classes = rows.sparkSession, (sizes["n_neg"], sizes["n_pos"])
    settings = [(g["trees"], 30 if g["depth"] is None else g["depth"], max(1, g["min_split"] // 2)) for g in grid]
    found, rule, cuts = forest.fit(rows, LABEL, FEATURES, settings, (sizes["weight_neg"] or 1.0, sizes["weight_pos"] or 1.0), classes, seed)

    def model(setting: tuple[int, int, int], nodes: DataFrame, first: int) -> RandomForestClassificationModel:
        count, depth, least = setting
        estimator = RandomForestClassifier(
            featuresCol=FEATURES, labelCol=LABEL, weightCol=WEIGHT, numTrees=count, maxDepth=depth,
            featureSubsetStrategy="sqrt", minInstancesPerNode=least, seed=seed)
        path = f"{checkpoint_dir(spark)}/forest-{uuid.uuid4().hex}"
        forest.save(nodes, first, count, depth, rule, cuts, path)
        forest.save_metadata(spark, estimator, count, rule.width, path)
        return RandomForestClassificationModel.load(path)

    fits = run_parallel([lambda s=s, n=n: model(s, *n) for s, n in zip(settings, found)], parallelism)
    return [Fitted("forest", f"forest_{i}", dict(g), m) for i, (g, m) in enumerate(zip(grid, fits))]


def fit_boosted_grid(train: DataFrame, label: str, grid=presets.BOOSTED_GRID, seed: int = 42,
                     parallelism: int = 8) -> list[Fitted]:
    """Spark's first-order boosted trees with positives weighted by the class ratio."""
    sizes = class_weights(train, label).first()
    weight = F.when(F.col(label) == 1, F.lit(float(sizes["scale_pos_weight"]))).otherwise(F.lit(1.0))
    rows = training_rows(
        train.select(F.col(label).cast("double").alias(LABEL), weight.alias(WEIGHT), FEATURES))
    checkpoint_dir(train.sparkSession)

    def fit(g: dict) -> Any:
        columns = "all" if g["columns"] >= 1.0 else str(g["columns"])
        return GBTClassifier(
            featuresCol=FEATURES, labelCol=LABEL, weightCol=WEIGHT, maxIter=g["trees"], maxDepth=g["depth"],
            stepSize=g["rate"], subsamplingRate=g["rows"], featureSubsetStrategy=columns, seed=seed,
            checkpointInterval=20).fit(rows)

    fits = run_parallel([lambda g=g: fit(g) for g in grid], parallelism)
    return [Fitted("boosted", f"boosted_{i}", dict(g), m) for i, (g, m) in enumerate(zip(grid, fits))]


def fit_newton_grid(train: DataFrame, label: str, grid=presets.BOOSTED_GRID, seed: int = 42) -> list[Fitted]:
    """Second-order boosted trees with positives weighted by the class ratio; all settings grow in the same passes."""
    positive = float(class_weights(train, label).first()["scale_pos_weight"])
    settings = [Setting(g["trees"], g["depth"], g["rate"], g["rows"], g["columns"]) for g in grid]
    fits = boosting.fit(train, label, settings, FEATURES, positive, seed)
    return [Fitted("boosted", f"boosted_{i}", dict(g), m) for i, (g, m) in enumerate(zip(grid, fits))]


def probability(fitted: Fitted, df: DataFrame, output: str = "p") -> DataFrame:
    """Add the positive-class probability only."""
    if isinstance(fitted.model, BoostedTrees):
        return df.withColumn(output, fitted.model.probability(F.col(FEATURES)))
    scored = quiet(fitted.model, f"__prob_{output}").transform(df)
    return scored.withColumn(output, vector_to_array(f"__prob_{output}")[1]).drop(f"__prob_{output}")


def quiet(model: Any, probability_column: str) -> Any:
    """A copy of the model that only writes the probability column."""
    copy = model.copy()
    copy.setProbabilityCol(probability_column)
    copy.setRawPredictionCol("")
    copy.setPredictionCol("")
    if getattr(copy, "hasSummary", False):
        # A training summary holds the session, which cannot travel to tasks once it has observed a query.
        copy._java_obj.setSummary(SparkContext._active_spark_context._jvm.scala.Option.empty())
    return copy


def margin(fitted: Fitted, df: DataFrame, output: str = "margin") -> DataFrame:
    """What Platt scaling is fitted on: log-odds of logistic models, else the probability."""
    if fitted.family != "logistic":
        return probability(fitted, df, output)
    scored = probability(fitted, df, "__p")
    p = F.col("__p")
    return scored.withColumn(output, F.log(p / (1.0 - p))).drop("__p")


def score_candidates(candidates: Sequence[Fitted], df: DataFrame, keep: list[str]) -> DataFrame:
    """Long table (keep, candidate, family, p): all models in one pass over the rows."""
    wide = df
    for i, c in enumerate(candidates):
        wide = probability(c, wide, f"__p{i}")
    pairs = [F.struct(F.lit(c.name).alias("candidate"), F.lit(c.family).alias("family"), F.col(f"__p{i}").alias("p"))
             for i, c in enumerate(candidates)]
    return wide.select(*keep, F.inline(F.array(*pairs)))


def search_records(candidates: Sequence[Fitted], validation: DataFrame, label: str) -> DataFrame:
    """Validation metrics of every candidate from one grouped evaluation."""
    scored = score_candidates(candidates, validation, [label])
    metrics = binary_metrics(scored, label, "p", ["family", "candidate"])
    spark = validation.sparkSession
    settings = spark.createDataFrame([(c.name, str(c.params)) for c in candidates], "candidate string, params string")
    return metrics.join(F.broadcast(settings), "candidate").select(
        "family", "candidate", "params", F.col("auroc").alias("val_auroc"),
        F.col("average_precision").alias("val_pr_auc"), F.col("brier").alias("val_brier"),
        F.col("youden_recall").alias("val_sensitivity"), F.col("youden_specificity").alias("val_specificity"),
        F.col("youden_f1").alias("val_f1"))


def best_of_families(candidates: Sequence[Fitted], records: DataFrame) -> dict[str, Fitted]:
    """Per family the candidate with the best validation average precision, first on ties."""
    rows = {r["candidate"]: r["val_pr_auc"] for r in records.select("candidate", "val_pr_auc").collect()}
    best: dict[str, Fitted] = {}
    for c in candidates:
        held = best.get(c.family)
        if held is None or (rows[c.name] or -1.0) > (rows[held.name] or -1.0):
            best[c.family] = c
    return best


def select_model(metrics: DataFrame, model: str, auroc: str, average_precision: str) -> DataFrame:
    """The model with the largest sum of AUROC and average precision."""
    total = F.col(auroc) + F.col(average_precision)
    best = metrics.agg(F.max(F.struct(total.alias("score"), F.col(model).alias("m"))).alias("b"))
    return best.select(F.col("b.m").alias("selected_model"), F.col("b.score").alias("selection_score"))


# --- calibration ---------------------------------------------------------------------

@dataclass(frozen=True)
class Platt:
    """p = sigmoid(slope * score + intercept)."""

    slope: float
    intercept: float

    def apply(self, score: Column) -> Column:
        return sigmoid(F.lit(self.slope) * score + F.lit(self.intercept))


def fit_platt(df: DataFrame, y: str, score: str, most_steps: int = 100) -> Platt:
    """Sigmoid calibration with smoothed targets.

    Equal scores are merged and written once; every Newton step is one
    aggregation over them. A step that doesn't lower the loss is halved. Scores
    are centred, and if they are all equal the slope is 0.
    """
    counts = written(score_counts(df, y, score))
    n = F.col("pos") + F.col("neg")
    row = counts.agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), (F.sum(n * F.col("score")) / F.sum(n)).alias("mean"),
                     F.count(F.lit(1)).alias("scores")).first()
    if not row["scores"]:
        return Platt(0.0, 0.0)
    high, low = (row["pos"] + 1.0) / (row["pos"] + 2.0), 1.0 / (row["neg"] + 2.0)
    s, up = F.col("score") - F.lit(float(row["mean"])), F.col("pos") * high + F.col("neg") * low
    at, best, step = np.zeros(2), np.inf, np.zeros(2)
    now = at.copy()
    for _ in range(most_steps):
        z = F.lit(float(now[0])) * s + F.lit(float(now[1]))
        p = sigmoid(z)
        softplus = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
        curve = n * p * (1.0 - p)
        t = counts.agg(F.sum(n * softplus - up * z).alias("loss"), F.sum((n * p - up) * s).alias("ga"), F.sum(n * p - up).alias("gb"),
                       F.sum(curve * s * s).alias("aa"), F.sum(curve * s).alias("ab"), F.sum(curve).alias("bb")).first()
        if t["loss"] > best + 1e-12 * abs(best):
            step /= 2.0
        else:
            at, best = now, t["loss"]
            if row["scores"] == 1:
                step = np.array([0.0, -t["gb"] / t["bb"]])
            else:
                step = -np.linalg.solve([[t["aa"], t["ab"]], [t["ab"], t["bb"]]], [t["ga"], t["gb"]])
        now = at + step
        if np.abs(step).max() <= 1e-12 * (1.0 + np.abs(at).max()):
            break
    return Platt(float(now[0]), float(now[1] - now[0] * row["mean"]))


def apply_isotonic(model: Any, df: DataFrame, score: str, output: str) -> DataFrame:
    """Interpolated step function, constant beyond the fitted range."""
    return (model.transform(df.withColumn("score", F.col(score).cast("double")))
            .withColumn(output, clip(F.col("__isotonic"), 0.0, 1.0)).drop("__isotonic", "score"))


# --- evaluation of variants and scorecard -------------------------------------------

def evaluation_catalog(df: DataFrame, y: str = "y", p: str = "p", keys: tuple[str, ...] = ("model", "variant"),
                       split: str = "split", n_bins: int = 10, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """All variants at once: thresholds from validation, metrics on test, gaps between them.

    One count per (variant, split, distinct score) feeds every metric.
    """
    by = [*keys, split]
    counts = materialize(score_counts(df, y, p, by))
    ranked = materialize(running_totals(counts, by, "score", {"tp": F.col("pos"), "fp": F.col("neg")}, descending=True))
    points = metrics_from_ranked(ranked, by, 0.5, low, high)
    errors = calibration_error(bin_table(counts, by, bin_of(F.col("score"), uniform_edges(n_bins))), by)
    full = same_keys(points, errors, by, "inner")

    val = full.where(F.col(split) == "validation").select(
        *keys, F.col("auroc").alias("val_auroc"), F.col("average_precision").alias("val_pr_auc"),
        F.col("brier").alias("val_brier"), F.col("ece").alias("val_ece"), F.col("mce").alias("val_mce"),
        "youden_threshold", "max_f1_threshold")
    test = full.where(F.col(split) == "test").select(
        *keys, "n_pos", "n_neg", F.col("auroc").alias("test_auroc"), F.col("average_precision").alias("test_pr_auc"),
        F.col("brier").alias("test_brier"), F.col("ece").alias("test_ece"), F.col("mce").alias("test_mce"),
        F.col("fixed_precision").alias("default_precision"), F.col("fixed_recall").alias("default_recall"),
        F.col("fixed_specificity").alias("default_specificity"), F.col("fixed_f1").alias("default_f1"))
    both = same_keys(test, val, list(keys), "inner")
    test_ranked = ranked.where(F.col(split) == "test").drop(split)
    both = counts_at(both, test_ranked, list(keys), "youden_threshold", "youden")
    both = counts_at(both, test_ranked, list(keys), "max_f1_threshold", "max_f1")

    def rates(prefix: str) -> list[Column]:
        tp, fp = F.col(f"{prefix}_tp"), F.col(f"{prefix}_fp")
        tn, fn = F.col("n_neg") - fp, F.col("n_pos") - tp
        return [share(tp, F.col("n_pos")).alias(f"{prefix}_recall"),
                share(tn, F.col("n_neg")).alias(f"{prefix}_specificity"),
                share(tp, tp + fp).alias(f"{prefix}_precision"),
                share(tn, tn + fn).alias(f"{prefix}_npv"),
                share(2.0 * tp, 2.0 * tp + fp + fn).alias(f"{prefix}_f1")]

    gap = lambda name: F.abs(F.col(f"val_{name}") - F.col(f"test_{name}")).alias(f"delta_{name}")
    return both.select(
        *keys, "n_pos", "n_neg", "test_auroc", "test_pr_auc", "val_auroc", "val_pr_auc",
        "test_brier", "test_ece", "test_mce", "val_brier", "val_ece", "val_mce",
        gap("auroc"), gap("pr_auc"), gap("brier"),
        "default_precision", "default_recall", "default_specificity", "default_f1",
        "youden_threshold", *rates("youden"), "max_f1_threshold", *rates("max_f1"))


def model_scorecard(catalog: DataFrame, split: str = "val", weights: dict[str, float] = presets.SCORE_WEIGHTS,
                    ratings: dict[str, float] = presets.INTERPRETABILITY,
                    default_rating: float = presets.INTERPRETABILITY_DEFAULT) -> DataFrame:
    """Weighted multi-criteria score of each model's best-calibrated variant.

    ``split`` chooses which metrics count: validation by default, or ``test`` to
    score the way published comparisons do.
    """
    auroc, ap, brier, ece = (F.col(f"{split}_{m}") for m in ("auroc", "pr_auc", "brier", "ece"))
    drift = F.col("delta_auroc") + F.col("delta_brier")
    best = (catalog.select("model", "variant", auroc.alias("auroc"), ap.alias("pr_auc"), brier.alias("brier"),
                           ece.alias("ece"), drift.alias("drift"))
            .groupBy("model").agg(F.min(F.struct("brier", "variant", "auroc", "pr_auc", "ece", "drift")).alias("b"))
            .select("model", "b.*"))
    top = best.agg(F.max("auroc").alias("max_auroc"), F.max("pr_auc").alias("max_ap"), F.min("brier").alias("min_brier"),
                   F.min("ece").alias("min_ece"), F.min("drift").alias("min_drift"))
    rating = None
    for name, value in ratings.items():
        hit = F.col("model") == name
        rating = F.when(hit, value) if rating is None else rating.when(hit, value)
    rating = F.lit(default_rating) if rating is None else rating.otherwise(default_rating)
    scored = best.join(F.broadcast(top)).select(
        "model", F.col("variant").alias("best_variant"), "auroc", "pr_auc", "brier", "ece",
        (0.5 * F.col("auroc") / F.col("max_auroc") + 0.5 * F.col("pr_auc") / F.col("max_ap")).alias("discrimination"),
        (0.5 * F.col("min_brier") / F.col("brier") + 0.5 * (F.col("min_ece") / (F.col("ece") + 1e-6))).alias("calibration"),
        rating.alias("interpretability"),
        (F.col("min_drift") / (F.col("drift") + 1e-6)).alias("stability"))
    composite = sum((F.col(k) * w for k, w in weights.items()), F.lit(0.0))
    return scored.withColumn("composite", composite)


def champion(scorecard: DataFrame, pin: str | None = None) -> DataFrame:
    """Row of the best composite, or of a pinned model when it is present."""
    preferred = F.when(F.col("model") == pin, 1).otherwise(0) if pin else F.lit(0)
    fields = [c for c in scorecard.columns if c not in ("composite", "model")]
    return scorecard.agg(F.max(F.struct(preferred.alias("pin"), "composite", "model", *fields)).alias("b")).select(
        F.col("b.model").alias("model"), F.col("b.composite").alias("composite"), *[F.col(f"b.{f}").alias(f) for f in fields])
