"""Ranking, threshold and calibration metrics of binary scores.

Every operator first merges equal scores (map-side combined), so a score shared
by a large part of the rows travels as one row, and works per group: models,
variants and splits are evaluated in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortmill.functions.columns import add_all, clip, count_true, share
from cohortmill.operators.running import attach, exact_quantiles, running_totals, same_keys
from cohortmill.session import materialize


def score_counts(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    """One row per distinct score and group: (by, score, pos, neg)."""
    by = by or []
    return (df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
            .groupBy(*by, F.col(p).cast("double").alias("score"))
            .agg(count_true(F.col(y) == 1).alias("pos"), count_true(F.col(y) != 1).alias("neg")))


def class_totals(counts: DataFrame, by: list[str]) -> DataFrame:
    return counts.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def with_totals(counts: DataFrame, by: list[str]) -> DataFrame:
    """Add n_pos, n_neg of the group (one row per group, or a single row)."""
    return attach(counts, class_totals(counts, by), by)


def ranked_scores(df: DataFrame, y: str, p: str, by: list[str] | None = None, **sizing) -> DataFrame:
    """Distinct scores with tp, fp = positives and negatives at or above the score."""
    by = by or []
    counts = materialize(score_counts(df, y, p, by))
    ranked = running_totals(counts, by, "score", {"tp": F.col("pos"), "fp": F.col("neg")},
                            descending=True, **sizing)
    return ranked


def auroc_column() -> Column:
    """Area under ROC over ranked score rows; ties count one half; null for one class."""
    pairs = F.sum(F.col("neg").cast("double") * (F.col("tp") - F.col("pos") / 2.0))
    area = F.max("tp").cast("double") * F.max("fp").cast("double")
    return F.when(area > 0, pairs / F.nullif(area, F.lit(0.0)))


def average_precision_column() -> Column:
    """Step-wise average precision over ranked score rows; null for one class."""
    steps = F.sum(F.col("pos").cast("double") * F.col("tp") / (F.col("tp") + F.col("fp")))
    ok = (F.max("tp") > 0) & (F.max("fp") > 0)
    return F.when(ok, steps / F.nullif(F.max("tp"), F.lit(0)))


def squared_error_column() -> Column:
    """Mean squared error from (score, pos, neg) rows."""
    miss = F.col("pos") * F.pow(1.0 - F.col("score"), F.lit(2)) + F.col("neg") * F.pow(F.col("score"), F.lit(2))
    return F.sum(miss) / F.nullif(F.sum(F.col("pos") + F.col("neg")), F.lit(0))


def ranking_metrics(df: DataFrame, y: str, p: str, by: list[str] | None = None, **sizing) -> DataFrame:
    """n, n_pos, auroc, average_precision and brier per group."""
    by = by or []
    return ranked_scores(df, y, p, by, **sizing).groupBy(*by).agg(
        F.sum(F.col("pos") + F.col("neg")).alias("n"),
        F.sum("pos").alias("n_pos"),
        auroc_column().alias("auroc"),
        average_precision_column().alias("average_precision"),
        squared_error_column().alias("brier"),
    )


def brier_score(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.pow(F.col(p) - F.col(y), F.lit(2))).alias("brier"))


def roc_points(df: DataFrame, y: str, p: str, by: list[str] | None = None, **sizing) -> DataFrame:
    """(threshold, fpr, tpr) per distinct score and the (0, 0) start at +infinity."""
    by = by or []
    ranked = with_totals(ranked_scores(df, y, p, by, **sizing), by)
    start = ranked.groupBy(*by).agg(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"),
                                    F.lit(0.0).alias("tpr"))
    points = ranked.select(*by, F.col("score").alias("threshold"),
                           share(F.col("fp"), F.col("n_neg")).alias("fpr"),
                           share(F.col("tp"), F.col("n_pos")).alias("tpr"))
    return start.unionByName(points)


def pr_points(df: DataFrame, y: str, p: str, by: list[str] | None = None, **sizing) -> DataFrame:
    """(threshold, precision, recall) per distinct score; ends at recall 0, precision 1."""
    by = by or []
    ranked = with_totals(ranked_scores(df, y, p, by, **sizing), by)
    end = ranked.groupBy(*by).agg(F.lit(None).cast("double").alias("threshold"),
                                  F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    points = ranked.select(*by, F.col("score").alias("threshold"),
                           (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
                           share(F.col("tp"), F.col("n_pos")).alias("recall"))
    return points.unionByName(end)


def youden_threshold(df: DataFrame, y: str, p: str, by: list[str] | None = None,
                     low: float = 0.0, high: float = 1.0, **sizing) -> DataFrame:
    """Threshold of the largest tpr - fpr, ties to the highest threshold.

    The gain is compared as the whole number tp*N - fp*P, so equal gains are
    equal. If no score beats 0 the threshold is +infinity, clipped to ``high``.
    """
    by = by or []
    ranked = with_totals(ranked_scores(df, y, p, by, **sizing), by)
    wide = "decimal(19,0)"
    gain = (F.col("tp").cast(wide) * F.col("n_neg").cast(wide)
            - F.col("fp").cast(wide) * F.col("n_pos").cast(wide))
    best = ranked.select(*by, "score", "n_pos", "n_neg", gain.alias("gain")).groupBy(*by).agg(
        F.max(F.struct("gain", "score")).alias("b"), F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"))
    beats = F.col("b.gain") > 0
    area = F.col("n_pos").cast("double") * F.col("n_neg").cast("double")
    return best.select(
        *by,
        F.when(beats, clip(F.col("b.score"), low, high)).otherwise(F.lit(float(high))).alias("youden_threshold"),
        F.when(beats, F.col("b.gain").cast("double") / F.nullif(area, F.lit(0.0)))
        .otherwise(F.lit(0.0)).alias("youden_j"))


def max_f1_threshold(df: DataFrame, y: str, p: str, by: list[str] | None = None,
                     low: float = 0.0, high: float = 1.0, **sizing) -> DataFrame:
    """Threshold of the largest F1, ties to the lowest threshold."""
    by = by or []
    ranked = with_totals(ranked_scores(df, y, p, by, **sizing), by)
    f1 = 2.0 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("n_pos"))
    best = ranked.select(*by, f1.alias("f1"), (-F.col("score")).alias("flipped")).groupBy(*by).agg(
        F.max(F.struct("f1", "flipped")).alias("b"))
    return best.select(*by, clip(-F.col("b.flipped"), low, high).alias("max_f1_threshold"),
                       F.col("b.f1").alias("max_f1"))


def confusion_columns(tp: Column, fp: Column, fn: Column, tn: Column) -> list[Column]:
    """Rates of a confusion table; 0 where a denominator is empty."""
    recall, specificity = share(tp, tp + fn), share(tn, tn + fp)
    return [
        tn.alias("tn"), fp.alias("fp"), fn.alias("fn"), tp.alias("tp"),
        share(tp, tp + fp).alias("precision"), recall.alias("recall"),
        specificity.alias("specificity"), share(tn, tn + fn).alias("npv"),
        share(2.0 * tp, 2.0 * tp + fp + fn).alias("f1"),
        ((recall + specificity) / 2.0).alias("balanced_accuracy"),
    ]


def operating_metrics(df: DataFrame, y: str, p: str, threshold: Column | float,
                      by: list[str] | None = None) -> DataFrame:
    """Confusion table and rates at ``p >= threshold`` in one aggregation.

    ``threshold`` is a number or a column that is constant inside each group.
    """
    by = by or []
    cut = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    flagged, positive = F.col(p) >= cut, F.col(y) == 1
    counts = df.groupBy(*by).agg(
        F.max(cut).alias("threshold"),
        count_true(positive & flagged).alias("__tp"), count_true(~positive & flagged).alias("__fp"),
        count_true(positive & ~flagged).alias("__fn"), count_true(~positive & ~flagged).alias("__tn"))
    return counts.select(*by, "threshold", *confusion_columns(
        F.col("__tp"), F.col("__fp"), F.col("__fn"), F.col("__tn")))


def confusion_matrix(df: DataFrame, y: str, p: str, threshold: float, by: list[str] | None = None) -> DataFrame:
    """Long confusion table (actual, predicted, n, share of the actual class)."""
    by = by or []
    cells = df.groupBy(*by, F.col(y).cast("int").alias("actual"),
                       (F.col(p) >= threshold).cast("int").alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))
    row = Window.partitionBy(*by, "actual")
    return cells.withColumn("row_share", F.col("n") / F.sum("n").over(row))


def uniform_edges(n_bins: int) -> list[float]:
    """0, 1/n, .. 1 as running multiples of the step, like numpy.linspace."""
    step = 1.0 / n_bins
    return [i * step for i in range(n_bins)] + [1.0]


def bin_of(score: Column, edges: list[float], right_closed: bool = False) -> Column:
    """Bin number from fixed edges; left-closed, or right-closed on request."""
    inner = edges[1:-1]
    tests = [(score > e) if right_closed else (score >= e) for e in inner]
    return add_all(F.when(t, 1).otherwise(0) for t in tests)


def bin_table(counts: DataFrame, by: list[str], bin_column: Column) -> DataFrame:
    """Per bin: n, mean score, observed rate and their gap; empty bins absent."""
    n = F.sum(F.col("pos") + F.col("neg"))
    return (counts.groupBy(*by, bin_column.cast("int").alias("bin"))
            .agg(n.alias("n"),
                 (F.sum(F.col("score") * (F.col("pos") + F.col("neg"))) / n).alias("confidence"),
                 (F.sum("pos") / n).alias("accuracy"))
            .withColumn("gap", F.abs(F.col("accuracy") - F.col("confidence"))))


def calibration_bins(df: DataFrame, y: str, p: str, by: list[str] | None = None, n_bins: int = 10) -> DataFrame:
    by = by or []
    return bin_table(score_counts(df, y, p, by), by, bin_of(F.col("score"), uniform_edges(n_bins)))


def reliability_curve(df: DataFrame, y: str, p: str, by: list[str] | None = None, n_bins: int = 8) -> DataFrame:
    """Calibration curve over right-closed uniform bins (the first also holds 0)."""
    by = by or []
    edges = uniform_edges(n_bins)
    return bin_table(score_counts(df, y, p, by), by, bin_of(F.col("score"), edges, right_closed=True)).drop("gap")


def quantile_bins(df: DataFrame, y: str, p: str, by: list[str] | None = None, n_bins: int = 10) -> DataFrame:
    """Calibration bins between exact score quantiles.

    The outer edges become 0 and 1, equal edges merge, and with fewer than three
    edges left the bins are uniform.
    """
    by = by or []
    quantiles = exact_quantiles(df, p, [i / n_bins for i in range(1, n_bins)], by)
    found = F.array_sort(F.array_distinct(F.array(
        F.lit(0.0), *[F.col(f"q{i}") for i in range(n_bins - 1)], F.lit(1.0))))
    uniform = F.array(*[F.lit(e) for e in uniform_edges(n_bins)])
    edges = quantiles.select(*by, F.when(F.size(found) < 3, uniform).otherwise(found).alias("edges"))
    counts = score_counts(df, y, p, by)
    joined = attach(counts, edges, by)
    reached = F.size(F.filter("edges", lambda e: e <= F.col("score"))) - 1
    index = F.greatest(F.lit(0), F.least(reached, F.size("edges") - 2))
    return bin_table(joined, by, index)


def calibration_error(bins: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Expected and maximum calibration error of a bin table."""
    by = by or []
    return bins.groupBy(*by).agg(
        F.sum("n").alias("n"),
        (F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"),
        F.max("gap").alias("mce"))


def binary_metrics(df: DataFrame, y: str, p: str, by: list[str] | None = None, threshold: float = 0.5,
                   low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Ranking metrics with the fixed, Youden and maximum-F1 operating points."""
    by = by or []
    counts = materialize(score_counts(df, y, p, by))
    ranked = materialize(running_totals(counts, by, "score", {"tp": F.col("pos"), "fp": F.col("neg")},
                                        descending=True))
    return metrics_from_ranked(ranked, by, threshold, low, high)


def metrics_from_ranked(ranked: DataFrame, by: list[str], threshold: float, low: float, high: float) -> DataFrame:
    """One row per group from a ranked score table; two small aggregations."""
    totals = ranked.groupBy(*by).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
        auroc_column().alias("auroc"), average_precision_column().alias("average_precision"),
        squared_error_column().alias("brier"))
    rows = attach(ranked, totals, by)
    wide = "decimal(19,0)"
    gain = (F.col("tp").cast(wide) * F.col("n_neg").cast(wide)
            - F.col("fp").cast(wide) * F.col("n_pos").cast(wide))
    f1 = 2.0 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("n_pos"))
    kept = ["n_pos", "n_neg", "auroc", "average_precision", "brier"]
    rows = rows.withColumns({"__gain": gain, "__f1": f1, "__flip": -F.col("score")})
    best = rows.groupBy(*by, *kept).agg(
        F.max(F.struct("__gain", "score")).alias("j"),
        F.max(F.struct("__f1", "__flip")).alias("f"),
        F.max(F.when(F.col("score") >= threshold, F.col("tp"))).alias("tp_fixed"),
        F.max(F.when(F.col("score") >= threshold, F.col("fp"))).alias("fp_fixed"))
    beats = F.col("j.__gain") > 0
    zero = F.lit(0).cast("bigint")
    raw = F.when(beats, F.col("j.score")).otherwise(F.lit(float("inf")))
    points = best.select(
        *by, *kept,
        F.coalesce("tp_fixed", zero).alias("tp"), F.coalesce("fp_fixed", zero).alias("fp"),
        clip(raw, low, high).alias("youden_threshold"),
        clip(-F.col("f.__flip"), low, high).alias("max_f1_threshold"), F.col("f.__f1").alias("max_f1"))
    return point_columns(counts_at(points, ranked, by, "youden_threshold", "youden"), by, kept, threshold)


def counts_at(points: DataFrame, ranked: DataFrame, by: list[str], threshold: str, prefix: str) -> DataFrame:
    """Add tp and fp at a per-group threshold: those of the last score at or above it."""
    rows = attach(ranked, points.select(*by, threshold), by)
    at = rows.where(F.col("score") >= F.col(threshold)).groupBy(*by).agg(
        F.max("tp").alias(f"__{prefix}_tp"), F.max("fp").alias(f"__{prefix}_fp"))
    merged = same_keys(points, at, by, "left") if by else points.join(F.broadcast(at), how="left")
    zero = F.lit(0).cast("bigint")
    return merged.withColumns({
        f"{prefix}_tp": F.coalesce(f"__{prefix}_tp", zero), f"{prefix}_fp": F.coalesce(f"__{prefix}_fp", zero),
    }).drop(f"__{prefix}_tp", f"__{prefix}_fp")


def point_columns(points: DataFrame, by: list[str], kept: list[str], threshold: float) -> DataFrame:
    def rates(prefix: str, tp: Column, fp: Column) -> list[Column]:
        fn, tn = F.col("n_pos") - tp, F.col("n_neg") - fp
        return [share(tp, tp + fp).alias(f"{prefix}_precision"),
                share(tp, F.col("n_pos")).alias(f"{prefix}_recall"),
                share(tn, F.col("n_neg")).alias(f"{prefix}_specificity"),
                share(2.0 * tp, 2.0 * tp + fp + fn).alias(f"{prefix}_f1")]

    return points.select(
        *by, *kept, F.lit(float(threshold)).alias("threshold"),
        *rates("fixed", F.col("tp"), F.col("fp")),
        "youden_threshold", *rates("youden", F.col("youden_tp"), F.col("youden_fp")),
        "max_f1_threshold", "max_f1")
