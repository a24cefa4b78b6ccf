"""Ranking, threshold and calibration metrics against brute force."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from cohortmill.operators import curves, reliability, running

ROWS = st.lists(st.tuples(st.integers(0, 1), st.integers(0, 12)), min_size=2, max_size=40)
QUICK = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def frame(spark, data):
    return spark.createDataFrame([(int(y), p / 12.0) for y, p in data], "y int, p double")


def pair_auroc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    if not len(pos) or not len(neg):
        return None
    return float(np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg]))


def step_ap(y, p):
    if y.sum() in (0, len(y)):
        return None
    total, recall = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        hit = p >= t
        now = y[hit].sum() / y.sum()
        total += (now - recall) * y[hit].mean()
        recall = now
    return total


@QUICK
@given(data=ROWS)
def test_ranking_metrics_match_brute_force(spark, data):
    y, p = np.array([d[0] for d in data]), np.array([d[1] / 12.0 for d in data])
    # one row per range forces the multi-range path
    for sizing in ({}, {"rows_per_range": 1}):
        got = curves.ranking_metrics(frame(spark, data), "y", "p", **sizing).first()
        for name, want in (("auroc", pair_auroc(y, p)), ("average_precision", step_ap(y, p))):
            assert (got[name] is None) == (want is None)
            if want is not None:
                assert got[name] == pytest.approx(want, abs=1e-12)
        assert got["brier"] == pytest.approx(float(np.mean((p - y) ** 2)), abs=1e-12)


@QUICK
@given(data=ROWS, q=st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.7, 0.9, 1.0]))
def test_quantiles_match_numpy(spark, data, q):
    values = [d[1] / 12.0 for d in data]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = running.exact_quantiles(df, "v", [q], rows_per_range=2).first()
    assert got["n"] == len(values)
    assert got["q0"] == pytest.approx(float(np.percentile(values, q * 100)), abs=1e-12)


def test_quantiles_interpolate(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", 2.0), ("g", 4.0), ("g", 10.0), (None, 7.0)], "g string, v double")
    got = {r["g"]: r for r in running.exact_quantiles(df, "v", [0.1, 0.5, 0.9], ["g"]).collect()}
    assert [round(got["g"][f"q{i}"], 9) for i in range(3)] == [1.3, 3.0, 8.2]
    assert got[None]["q1"] == 7.0


def test_narrowed_quantiles_are_exact(spark):
    rng = np.random.default_rng(9)
    groups = {"even": rng.normal(size=6000), "heavy": np.round(rng.exponential(size=5000), 1), "one": np.array([3.0])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("even", None)], "g string, v double")
    qs = [0.0, 0.05, 0.5, 0.51, 0.9, 1.0]
    got = {r["g"]: r for r in running.exact_quantiles(df, "v", qs, ["g"], rows_per_range=100, narrow=True).collect()}
    for g, vs in groups.items():
        assert got[g]["n"] == len(vs)
        for i, q in enumerate(qs):
            assert got[g][f"q{i}"] == pytest.approx(float(np.percentile(vs, q * 100)), abs=1e-12)
    kept, _ = running.near_ranks(df.where("v is not null and g = 'even'"), "v", [0.5], ["g"])
    assert kept.count() < 100


def test_running_totals_many_ranges(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"))
    out = running.running_totals(df, ["g"], "v", {"c": F.lit(1)}, rows_per_range=50)
    assert out.where(F.col("c") != F.floor(F.col("v") / 3) + 1).count() == 0
    down = running.running_totals(df, ["g"], "v", {"c": F.lit(1)}, descending=True, rows_per_range=50)
    assert down.groupBy("g").agg(F.max("c")).count() == 3
    assert down.where("v = 999").first()["c"] == 1


def test_thresholds_tie_rules(spark):
    # gains of 0.8 and 0.4 are equal: Youden takes the higher one
    df = spark.createDataFrame([(1, 0.8), (0, 0.6), (1, 0.4), (0, 0.2)], "y int, p double")
    assert curves.youden_threshold(df, "y", "p").first()["youden_threshold"] == 0.8
    # no score beats 0: infinity, clipped
    worst = spark.createDataFrame([(0, 0.9), (1, 0.1)], "y int, p double")
    assert curves.youden_threshold(worst, "y", "p", high=0.99).first()["youden_threshold"] == 0.99
    # equal F1 of 2/3 at 0.9 and 0.1: maximum F1 takes the lower one
    f1 = spark.createDataFrame([(1, 0.9), (0, 0.5), (0, 0.4), (1, 0.1)], "y int, p double")
    assert curves.max_f1_threshold(f1, "y", "p").first()["max_f1_threshold"] == 0.1


def test_binary_metrics_bundle(spark):
    rng = np.random.default_rng(3)
    p = rng.integers(0, 50, 400) / 50.0
    y = (rng.random(400) < p).astype(int)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")
    got = curves.binary_metrics(df, "y", "p").first()
    assert got["auroc"] == pytest.approx(pair_auroc(y, p))
    best = max(sorted(set(p)), key=lambda t: ((p[y == 1] >= t).mean() - (p[y == 0] >= t).mean(), t))
    assert got["youden_threshold"] == pytest.approx(best)
    assert got["youden_recall"] == pytest.approx((p[y == 1] >= best).mean())
    assert got["fixed_specificity"] == pytest.approx((p[y == 0] < 0.5).mean())


def test_bin_edges(spark):
    df = spark.createDataFrame([(1, 0.0), (0, 0.1), (1, 0.3), (0, 1.0)], "y int, p double")
    # 3 * 0.1 is just above 0.3, so 0.3 belongs to bin 2
    assert sorted(r["bin"] for r in curves.calibration_bins(df, "y", "p").collect()) == [0, 1, 2, 9]
    right = curves.reliability_curve(spark.createDataFrame([(1, 0.25), (0, 0.26)], "y int, p double"), "y", "p", n_bins=4)
    assert sorted(r["bin"] for r in right.collect()) == [0, 1]


def test_quantile_bins_fall_back_to_uniform(spark):
    # the deciles are all 0, so only the edges 0 and 1 are left
    df = spark.createDataFrame([(0, 0.0)] * 20 + [(1, 1.0)], "y int, p double")
    bins = curves.quantile_bins(df, "y", "p")
    assert sorted(r["bin"] for r in bins.collect()) == [0, 9]
    assert curves.calibration_error(bins).first()["n"] == 21


def test_roc_and_pr_ends(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.3), (0, 0.1)], "y int, p double")
    roc = curves.roc_points(df, "y", "p").orderBy(F.desc("threshold")).collect()
    assert (roc[0]["fpr"], roc[0]["tpr"]) == (0.0, 0.0) and math.isinf(roc[0]["threshold"])
    assert (roc[-1]["fpr"], roc[-1]["tpr"]) == (1.0, 1.0)
    last = curves.pr_points(df, "y", "p").where("threshold is null").first()
    assert (last["precision"], last["recall"]) == (1.0, 0.0)


def accept_rows(spark, n=400):
    rng = np.random.default_rng(7)
    p = np.round(rng.random(n), 2)
    y = (rng.random(n) < p).astype(int)
    u, q = np.round(rng.random(n), 2), np.round(rng.random(n), 2)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(y, p, u, q)], "y double, p double, u double, q double")
    return df.withColumn("y", F.col("y").cast("int")), y, p, u, q


def test_strategies_against_masks(spark):
    df, y, p, u, q = accept_rows(spark)
    t = reliability.Thresholds(0.5, 0.3)
    masks = {"model_only": np.ones(len(y), bool), "uncertainty_abstain": u < 0.5, "dq_abstain": q >= 0.3,
             "combined": (u < 0.5) & (q >= 0.3)}
    for r in reliability.evaluate_strategies(df, "y", "p", "u", "q", t, rows_per_range=7).collect():
        m = masks[r["strategy"]]
        assert r["n_accepted"] == m.sum() and r["coverage"] == pytest.approx(m.mean())
        assert r["auroc"] == pytest.approx(pair_auroc(y[m], p[m]))
        assert r["pr_auc"] == pytest.approx(step_ap(y[m], p[m]))
        assert r["error_rate"] == pytest.approx(np.mean((p[m] >= 0.5) != y[m]))
        assert r["brier"] == pytest.approx(np.mean((p[m] - y[m]) ** 2))


def test_nothing_accepted(spark):
    df, *_ = accept_rows(spark, 20)
    got = {r["strategy"]: r for r in reliability.evaluate_strategies(
        df, "y", "p", "u", "q", reliability.Thresholds(-1.0, 2.0)).collect()}
    assert got["combined"]["n_accepted"] == 0 and got["combined"]["auroc"] is None and got["model_only"]["coverage"] == 1.0


def test_grid_choice_and_fallback(spark):
    df, y, p, u, q = accept_rows(spark)
    us, qs = [0.6, 0.8, 0.95], [0.05, 0.1, 0.2]
    grid = reliability.threshold_grid(df, "y", "p", "u", "q", us, qs, 0.5, rows_per_range=9)
    best = None
    for r in grid.orderBy("thresh_u", "thresh_dq").collect():
        m = (u < r["thresh_u"]) & (q >= r["thresh_dq"])
        assert r["n_accepted"] == m.sum()
        assert r["eligible"] == (m.sum() >= 10 and m.mean() >= 0.5)
        if r["eligible"]:
            assert r["auroc_accepted"] == pytest.approx(pair_auroc(y[m], p[m]))
            if best is None or r["auroc_accepted"] > best[0]:
                best = (r["auroc_accepted"], r["thresh_u"], r["thresh_dq"])
    choice = reliability.threshold_choice(grid).first()
    assert (choice["thresh_u"], choice["thresh_dq"]) == best[1:]
    none = reliability.threshold_choice(reliability.threshold_grid(df, "y", "p", "u", "q", us, qs, 1.1)).first()
    assert (none["thresh_u"], none["thresh_dq"], none["eligible"]) == (0.95, 0.05, False)


def test_sweep_against_masks(spark):
    df, y, p, u, q = accept_rows(spark)
    median = float(np.median(q))
    points = reliability.risk_coverage(df, "y", "p", "u", "q", 8, rows_per_range=11).orderBy("point").collect()
    assert points[0]["thresh_u"] == pytest.approx(u.min() + 1e-6) and points[-1]["thresh_u"] == pytest.approx(u.max() + 1e-6)
    for r in points:
        m = (u < r["thresh_u"]) & (q >= median)
        assert r["n_accepted"] == m.sum()
        if m.sum() >= 5:
            assert r["brier"] == pytest.approx(np.mean((p[m] - y[m]) ** 2))
            want = pair_auroc(y[m], p[m])
            assert (r["auroc"] is None) == (want is None) and (want is None or r["auroc"] == pytest.approx(want))
        else:
            assert r["brier"] is None


def test_decision_and_reasons(spark):
    df = spark.createDataFrame([(1, 0.1, 0.5), (2, 0.2, 0.5), (3, 0.1, 0.4), (4, None, 0.5)], "k int, u double, q double")
    got = {r["k"]: (r["decision"], len(r["reasons"])) for r in reliability.decide(
        df, "u", "q", reliability.Thresholds(0.2, 0.45)).collect()}
    assert got == {1: ("ACCEPT", 0), 2: ("ABSTAIN", 1), 3: ("ABSTAIN", 1), 4: ("ABSTAIN", 1)}
    nulls = reliability.strategy_decisions(df, "k", "u", "q", reliability.Thresholds(0.2, 0.45)).where("accept is null")
    assert nulls.count() == 0
    with pytest.raises(ValueError):
        reliability.choose_thresholds(df.where("false").selectExpr("k", "1 y", "u p", "u", "q"), "y", "p", "u", "q")
    assert reliability.risk_coverage(df.where("false").selectExpr("k", "1 y", "u p", "u", "q"), "y", "p", "u", "q").count() == 0


def test_quality_score_defaults(spark):
    df = spark.createDataFrame([(1, 30, 7, 0), (2, 0, 0, 200)], "k int, available_lab_count int, "
                               "available_vital_count int, missing_feature_count int")
    shares = spark.createDataFrame([(1, 1.0)], "k int, clean_frac double")
    got = {r["k"]: r["data_quality_score"] for r in reliability.data_quality_score(df, "k", shares, 111).collect()}
    assert got[1] == pytest.approx(1.0) and got[2] == pytest.approx(0.05)
    bare = reliability.data_quality_score(df.select("k"), "k", None, 111).first()["data_quality_score"]
    assert bare == pytest.approx(0.2 + 0.05)


def test_average_precision_of_huge_counts(spark):
    ranked = spark.createDataFrame([(0.5, 4_000_000_000, 5, 4_000_000_000, 5)], "score double, pos bigint, neg bigint, tp bigint, fp bigint")
    assert ranked.agg(curves.average_precision_column()).first()[0] == pytest.approx(1.0)


def test_narrowed_quantiles_of_few_values(spark):
    """A bracket that ends at the rank below would take the rank above from the next bracket."""
    sizes, shares = range(1000, 1600, 40), [0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5]
    rows = spark.range(1600).crossJoin(spark.createDataFrame([(n,) for n in sizes], "g int")).where("id < g").select(
        "g", (F.col("id") * 1.0).alias("v"))
    for r in running.exact_quantiles(rows, "v", shares, ["g"], narrow=True).collect():
        assert [r[f"q{i}"] for i in range(7)] == pytest.approx(list(np.quantile(np.arange(r["g"]), shares)), abs=1e-9)
    for n in (1000, 1307):
        r = running.wide_quantiles(rows.where(f"g = 1560 and id < {n}"), ["v"], shares).first()
        assert [r[f"q{i}"] for i in range(7)] == pytest.approx(list(np.quantile(np.arange(n), shares)), abs=1e-9)
