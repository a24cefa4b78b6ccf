"""Fitted models, calibrators, bootstrap, attributions, persistence and streaming."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Observation, functions as F

from cohortmill import presets
from cohortmill.functions.columns import poisson_one, poisson_one_cdf, unit_hash
from cohortmill.operators import attribution, bootstrap, forest, isotonic, logistic, models, reliability, split, trees
from cohortmill.streaming.score import Artifacts, score_new, score_stream


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-z))


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(600, 4)).round(3)
    y = (rng.random(600) < sigmoid(1.2 * x[:, 0] - 0.8 * x[:, 1] - 1.5)).astype(int)
    df = spark.createDataFrame([(i, int(b), *map(float, a)) for i, (a, b) in enumerate(zip(x, y))],
                               "k long, y int, a double, b double, c double, d double")
    vec = df.select("k", "y", array_to_vector(F.array("a", "b", "c", "d")).alias("features")).cache()
    return vec, x, y, df


def newton_logistic(x, y, weights, c, l2=True):
    """Minimise sum of weighted losses times C plus half the squared norm."""
    z = np.hstack([x, np.ones((len(x), 1))])
    beta = np.zeros(z.shape[1])
    penalty = np.eye(z.shape[1]) * (1.0 if l2 else 0.0)
    penalty[-1, -1] = 0.0
    for _ in range(60):
        p = sigmoid(z @ beta)
        grad = c * z.T @ (weights * (p - y)) + penalty @ beta
        hess = c * (z * (weights * p * (1 - p))[:, None]).T @ z + penalty
        beta = beta - np.linalg.solve(hess, grad)
    return beta


def test_logistic_matches_penalised_newton(data):
    vec, x, y, _ = data
    fitted = models.fit_logistic_grid(vec, "y", (0.1,))[0]
    weights = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    want = newton_logistic(x, y, weights, 0.1)
    assert np.allclose(fitted.model.coefficients.toArray(), want[:-1], atol=1e-4)
    assert fitted.model.intercept == pytest.approx(want[-1], abs=1e-4)


def test_a_logistic_grid_shares_few_scans_and_ends_at_its_minima(spark, data, monkeypatch):
    vec, x, y, _ = data
    weights = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    monkeypatch.setattr(logistic, "ROWS_PER_BLOCK", 64)
    scans, count = [], logistic.terms
    monkeypatch.setattr(logistic, "terms", lambda table, tasks, betas: scans.append(len(betas)) or count(table, tasks, betas))
    grid = (0.001, 0.1, 10.0)
    fits = models.fit_logistic_grid(vec, "y", grid)
    assert scans[0] == 3 and len(scans) < 15
    for c, f in zip(grid, fits):
        want = newton_logistic(x, y, weights, c)
        assert np.allclose([*f.model.coefficients.toArray(), f.model.intercept], want, rtol=1e-9, atol=1e-9)
        assert f.model.summary.totalIterations <= len(scans) and f.model.summary.areaUnderROC > 0.6


def test_platt_matches_newton_on_smoothed_targets(spark):
    rng = np.random.default_rng(5)
    score = rng.integers(0, 30, 300) / 30.0
    y = (rng.random(300) < score).astype(int)
    df = spark.createDataFrame([(int(b), float(s)) for b, s in zip(y, score)], "y int, s double")
    n_pos, n_neg = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (n_pos + 1) / (n_pos + 2), 1 / (n_neg + 2))
    want = newton_logistic(score[:, None], target, np.ones(len(y)), 1.0, l2=False)
    got = models.fit_platt(df, "y", "s")
    assert (got.slope, got.intercept) == (pytest.approx(want[0], abs=1e-4), pytest.approx(want[1], abs=1e-4))


def pava(score, y):
    keys = sorted(set(score))
    blocks = [[np.mean(y[score == k]), float(np.sum(score == k)), [k]] for k in keys]
    i = 0
    while i < len(blocks) - 1:
        if blocks[i][0] > blocks[i + 1][0]:
            a, b = blocks[i], blocks.pop(i + 1)
            a[0] = (a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1])
            a[1] += b[1]
            a[2] += b[2]
            i = max(i - 1, 0)
        else:
            i += 1
    return {k: b[0] for b in blocks for k in b[2]}


def test_isotonic_matches_pool_adjacent_violators(spark):
    rng = np.random.default_rng(6)
    score = rng.integers(0, 20, 250) / 20.0
    y = (rng.random(250) < score).astype(int)
    df = spark.createDataFrame([(int(b), float(s)) for b, s in zip(y, score)], "y int, s double")
    want = pava(score, y)
    out = models.apply_isotonic(models.fit_isotonic(df, "y", "s"), df, "s", "p")
    assert all(abs(r["p"] - want[r["s"]]) < 1e-9 for r in out.collect())
    outside = models.apply_isotonic(models.fit_isotonic(df, "y", "s"),
                                    spark.createDataFrame([(-1.0,), (2.0,)], "s double"), "s", "p")
    assert sorted(r["p"] for r in outside.collect()) == pytest.approx([min(want.values()), max(want.values())])


@pytest.mark.parametrize("kind", ["noisy", "rising", "falling", "steps"])
def test_pooling_in_ranges_equals_pooling_at_once(spark, kind):
    rng = np.random.default_rng(9)
    n = 700
    total = {"noisy": rng.integers(0, 2, n) * (np.arange(n) > rng.integers(0, n, n)), "rising": np.arange(n),
             "falling": n - np.arange(n), "steps": np.where(np.arange(n) % 100 == 0, 0, np.arange(n) // 3)}[kind].astype(float)
    weight = rng.integers(1, 4, n).astype(float)
    counts = spark.createDataFrame([(i / 7.0, float(t), float(w)) for i, (t, w) in enumerate(zip(total * weight, weight))],
                                   "score double, total double, weight double").repartition(3)
    want = isotonic.pool(total * weight, weight)
    for size in (40, 10_000):
        got = isotonic.pooled(counts, size).orderBy("low").collect()
        shown = [(r["low"], r["high"], r["total"], r["weight"]) for r in got]
        assert np.allclose(shown, [(a / 7.0, b / 7.0, t, w) for a, b, t, w in want])


def test_isotonic_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "score double, total double, weight double")
    assert isotonic.pooled(empty).collect() == []


def test_grids_records_and_choice(data):
    vec, _, _, _ = data
    train, val = vec.where("k % 3 > 0"), vec.where("k % 3 = 0")
    candidates = (models.fit_logistic_grid(train, "y", (0.01, 1.0))
                  + models.fit_forest_grid(train, "y", ({"trees": 10, "depth": None, "min_split": 10},))
                  + models.fit_boosted_grid(train, "y", ({"trees": 5, "depth": 2, "rate": 0.1, "rows": 0.8, "columns": 0.8},)))
    records = models.search_records(candidates, val, "y")
    rows = {r["candidate"]: r for r in records.collect()}
    assert set(rows) == {"logistic_0", "logistic_1", "forest_0", "boosted_0"}
    assert all(r["val_auroc"] > 0.6 for r in rows.values())
    best = models.best_of_families(candidates, records)
    assert rows[best["logistic"].name]["val_pr_auc"] == max(rows[n]["val_pr_auc"] for n in ("logistic_0", "logistic_1"))


def test_models_score_in_a_session_that_has_observed(spark, data):
    vec = data[0]
    seen = Observation("rows")
    vec.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    fitted = models.fit_logistic_grid(vec, "y", (0.1,))[0]
    assert models.probability(fitted, vec).where("p between 0 and 1").count() == seen.get["n"]
    assert fitted.model.hasSummary


def test_published_scorecard_parts(spark):
    # best calibrated variants of a published comparison: discrimination and calibration columns
    data = [("logistic", "sigmoid_platt", .8499, .4797, .0547, .0266), ("forest", "isotonic", .7787, .2284, .0650, .0412),
            ("boosted", "sigmoid_platt", .7472, .2199, .0659, .0097)]
    catalog = spark.createDataFrame([(*r, 0.01, 0.01) for r in data],
                                    "model string, variant string, test_auroc double, test_pr_auc double, test_brier double, "
                                    "test_ece double, delta_auroc double, delta_brier double")
    got = {r["model"]: r for r in models.model_scorecard(catalog, "test").collect()}
    assert got["logistic"]["discrimination"] == pytest.approx(1.0)
    assert got["boosted"]["discrimination"] == pytest.approx(0.5 * .7472 / .8499 + 0.5 * .2199 / .4797)
    assert got["forest"]["calibration"] == pytest.approx(0.5 * .0547 / .0650 + 0.5 * .0097 / (.0412 + 1e-6))
    card = models.model_scorecard(catalog, "test")
    assert models.champion(card).first()["model"] == "logistic"
    assert models.champion(card, pin="boosted").first()["model"] == "boosted"


# --- bootstrap ------------------------------------------------------------------------------

def test_resample_counts_are_poisson_and_stable(spark):
    df = spark.range(20000).withColumnRenamed("id", "k")
    w = bootstrap.resample_weights(df, "k", 2)
    stats = w.groupBy("resample").agg(F.avg("copies"), F.var_pop("copies")).collect()
    assert all(abs(r[1] - 1) < 0.03 and abs(r[2] - 1) < 0.06 for r in stats)
    again = bootstrap.resample_weights(df.repartition(5), "k", 2)
    assert w.exceptAll(again).count() == 0


def test_counts_are_the_same_without_the_number(spark):
    df = spark.range(20000).withColumnRenamed("id", "k")
    edges = poisson_one_cdf()
    unit = unit_hash(F.concat((F.lit(42) + F.col("resample")).cast("string"), F.lit(":"), F.col("k").cast("string")))
    want = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col("u")))
    got = bootstrap.resample_weights(df, "k", 3).withColumn("u", unit)
    assert got.where(F.col("copies") != want).count() == 0
    assert "conv(" not in bootstrap.resample_weights(df, "k", 3)._jdf.queryExecution().toString()
    # The ends of the scale, and both sides of every edge.
    near = sorted({v for e in edges for v in (math.ceil(e * 2 ** 32) - 1, math.ceil(e * 2 ** 32)) if v < 2 ** 32} | {0, 2 ** 32 - 1})
    ends = spark.createDataFrame([(f"{v:08x}", sum(e <= v / 2 ** 32 for e in edges)) for v in near], "d string, want int")
    assert ends.where(poisson_one(F.col("d")) != F.col("want")).count() == 0


def test_resampling_spreads_rows_that_come_in_one_piece(spark):
    df = spark.range(0, 2_000_000, 1, 1).select((F.col("id") * 7919).alias("k"))
    w = bootstrap.resample_weights(df, "k", 1).groupBy(F.spark_partition_id()).agg(F.sum("copies")).collect()
    assert len(w) > 1


def test_ensemble_spread_matches_refits(data):
    vec, x, y, _ = data
    small = vec.where("k < 200")
    ensemble = bootstrap.fit_ensemble(small, "k", "y", resamples=3)
    counts = {(r["k"], r["resample"]): r["copies"] for r in bootstrap.resample_weights(small, "k", 3).collect()}
    scores = []
    for b in range(3):
        copies = np.array([counts[(i, b)] for i in range(200)], dtype=float)
        pos, neg = copies[y[:200] == 1].sum(), copies[y[:200] == 0].sum()
        weights = copies * np.where(y[:200] == 1, (pos + neg) / (2 * pos), (pos + neg) / (2 * neg))
        beta = newton_logistic(x[:200], y[:200], weights, 0.1)
        scores.append(sigmoid(x @ beta[:-1] + beta[-1]))
        assert np.allclose(ensemble.coefficients[b], beta[:-1], atol=1e-6)
        assert ensemble.intercepts[b] == pytest.approx(beta[-1], abs=1e-6)
    rows = ensemble.spread(vec).orderBy("k").collect()
    assert np.allclose([r["boot_mean"] for r in rows], np.mean(scores, axis=0), atol=1e-6)
    assert np.allclose([r["boot_std"] for r in rows], np.std(scores, axis=0), atol=1e-6)


def test_resamples_share_their_scans(data, monkeypatch):
    vec, _, _, _ = data
    passes = []
    once = bootstrap.newton_terms
    monkeypatch.setattr(bootstrap, "newton_terms", lambda *a: passes.append(len(a[1])) or once(*a))
    together = bootstrap.fit_ensemble(vec.repartition(5), "k", "y", resamples=12)
    assert len(passes) <= 12 and passes[0] == 12
    # Fewer resamples at a time, other partitions: the same models.
    monkeypatch.setattr(bootstrap, "NUMBERS_PER_PASS", 5 * 5 * 5)
    apart = bootstrap.fit_ensemble(vec.repartition(2), "k", "y", resamples=12)
    assert max(passes[1:]) <= 12 and 5 in passes
    assert np.allclose(together.coefficients, apart.coefficients, atol=1e-8)


@pytest.mark.parametrize("slow_after, slow_ratio", [(10, 0.3), (1, 0.0)])
def test_many_rows_share_a_hessian(data, monkeypatch, slow_after, slow_ratio):
    """One Hessian a scan for all resamples, the same models; slow ones go back to their own."""
    vec, _, _, _ = data
    apart = bootstrap.fit_ensemble(vec, "k", "y", resamples=12)
    held, once = [], bootstrap.newton_terms

    def counted(*a):
        found = once(*a)
        held.append(sum(len(t) > 1 + 5 for r, t in found.items() if r >= 0) + (-1 in found))
        return found

    monkeypatch.setattr(bootstrap, "newton_terms", counted)
    for name, value in (("SHARED_FROM", 1), ("SLOW_AFTER", slow_after), ("SLOW_RATIO", slow_ratio)):
        monkeypatch.setattr(bootstrap, name, value)
    together = bootstrap.fit_ensemble(vec, "k", "y", resamples=12)
    assert held[:slow_after] == [1] * slow_after and (slow_ratio > 0 or 12 in held)
    assert np.allclose(together.coefficients, apart.coefficients, atol=1e-8)
    assert np.allclose(together.intercepts, apart.intercepts, atol=1e-8)


def test_newton_steps_are_halved_when_they_overshoot(spark):
    rows = [(i, int(i % 2), 40.0 * (i % 2) + (i % 7) * 3.0, float(i % 3) * 25.0) for i in range(90)]
    vec = spark.createDataFrame(rows, "k long, y int, a double, b double").select(
        "k", "y", array_to_vector(F.array("a", "b")).alias("features"))
    got = bootstrap.fit_ensemble(vec, "k", "y", resamples=2, c=100.0)
    counts = {(r["k"], r["resample"]): r["copies"] for r in bootstrap.resample_weights(vec, "k", 2).collect()}
    x, y = np.array([r[2:] for r in rows]), np.array([r[1] for r in rows])
    for b in range(2):
        copies = np.array([counts[(i, b)] for i in range(90)], float)
        n = np.array([copies[y == 0].sum(), copies[y == 1].sum()])
        w = copies * (n.sum() / (2 * n))[y]
        z = x @ got.coefficients[b] + got.intercepts[b]
        slope = 100.0 * (x.T @ (w * (sigmoid(z) - y))) + got.coefficients[b]
        assert np.abs(slope).max() < 1e-5


def test_one_class_resamples_are_dropped(spark, data):
    vec, _, _, _ = data
    positives = vec.where("y = 1").limit(1)
    rare = vec.where("y = 0").limit(30).unionByName(positives)
    ensemble = bootstrap.fit_ensemble(rare, "k", "y", resamples=6)
    assert 0 < ensemble.size < 6
    with pytest.raises(ValueError):
        bootstrap.fit_ensemble(vec.where("y = 0").limit(20), "k", "y", resamples=2)


# --- attributions ------------------------------------------------------------------------------

def conditional(nodes, values, x, known, node=0):
    """Expected tree output when only the features in ``known`` are given."""
    n = nodes[node]
    if n["left"] < 0:
        return values[node]
    if n["feature"] in known:
        return conditional(nodes, values, x, known, n["left"] if x[n["feature"]] <= n["cut"] else n["right"])
    share = nodes[n["left"]]["count"] / n["count"]
    return (share * conditional(nodes, values, x, known, n["left"])
            + (1 - share) * conditional(nodes, values, x, known, n["right"]))


def brute_shap(nodes, values, x):
    m = len(x)
    phi = np.zeros(m)
    for i in range(m):
        rest = [j for j in range(m) if j != i]
        for size in range(m):
            w = math.factorial(size) * math.factorial(m - size - 1) / math.factorial(m)
            for s in itertools.combinations(rest, size):
                phi[i] += w * (conditional(nodes, values, x, {*s, i}) - conditional(nodes, values, x, set(s)))
    return phi


def test_shap_matches_all_coalitions():
    rng = np.random.default_rng(2)
    nodes, values = {}, {}

    def grow(node, depth, count):
        values[node] = float(rng.normal())
        if depth == 0 or count < 4:
            nodes[node] = {"left": -1, "right": -1, "feature": -1, "cut": None, "count": count}
            return node + 1
        left = float(rng.integers(1, int(count)))
        after = grow(node + 1, depth - 1, left)
        end = grow(after, depth - 1, count - left)
        nodes[node] = {"left": node + 1, "right": after, "feature": int(rng.integers(0, 5)),
                       "cut": float(rng.normal()), "count": count}
        return end

    grow(0, 5, 200.0)
    leaves = trees.tree_leaves(nodes, 1.0, values)
    x = rng.normal(size=(6, 5))
    got = trees.shap_matrix(x, leaves)
    want = np.array([brute_shap(nodes, values, row) for row in x])
    assert np.allclose(got, want, atol=1e-9)


@pytest.mark.parametrize("family", ["boosted", "forest"])
def test_attributions_add_up_to_the_model_output(spark, data, tmp_path, family):
    vec, _, _, _ = data
    if family == "boosted":
        fitted = models.fit_boosted_grid(vec, "y", ({"trees": 8, "depth": 4, "rate": 0.2, "rows": 1.0, "columns": 1.0},))[0]
    else:
        fitted = models.fit_forest_grid(vec, "y", ({"trees": 8, "depth": 5, "min_split": 5},))[0]
    path = str(tmp_path / family)
    fitted.model.write().overwrite().save(path)
    leaves = trees.read_leaves(spark, path, family)
    long = attribution.tree_shap(vec, "k", leaves, ["a", "b", "c", "d"])
    total = long.groupBy("k").agg((F.sum("shap_value") + F.max("base_value")).alias("out"))
    p = models.probability(fitted, vec).select("k", "p")
    joined = total.join(p, "k").collect()
    assert len(joined) == 600
    for r in joined:
        want = math.log(r["p"] / (1 - r["p"])) if family == "boosted" else r["p"]
        assert r["out"] == pytest.approx(want, abs=1e-6)
    assert long.count() == 2400


def test_a_deep_forest_is_explained_in_blocks(spark, data, tmp_path, monkeypatch):
    """200 trees of unlimited depth: many blocks of leaves and rows, nothing collected beyond one block."""
    vec, _, _, _ = data
    fitted = models.fit_forest_grid(vec, "y", ({"trees": 200, "depth": None, "min_split": 2},))[0]
    path = str(tmp_path / "deep")
    fitted.model.write().overwrite().save(path)
    leaves = trees.read_leaves(spark, path, "forest")
    assert leaves.count() > 4 * trees.LEAVES_PER_BLOCK and leaves.agg(F.max(F.size("features"))).first()[0] == 4
    monkeypatch.setattr(trees, "ROWS_PER_BLOCK", 100)
    some = vec.where("k < 250")
    monkeypatch.setattr(trees, "_beside_rows", None)
    got = trees.tree_shap_rows(some, "k", leaves)
    p = models.probability(fitted, some).select("k", "p")
    rows = got.join(p, "k").collect()
    assert len(rows) == 250
    for r in rows:
        assert r["base_value"] + sum(r["shap_values"]) == pytest.approx(r["p"], abs=1e-9)


def test_one_block_of_leaves_moves_no_rows(spark, data, tmp_path):
    vec, _, _, _ = data
    fitted = models.fit_forest_grid(vec, "y", ({"trees": 3, "depth": 3, "min_split": 5},))[0]
    fitted.model.write().overwrite().save(str(tmp_path / "small"))
    rows = trees.tree_shap_rows(vec, "k", trees.read_leaves(spark, str(tmp_path / "small"), "forest"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and rows.count() == 600


def test_blocks_of_leaves_give_what_one_block_gives(spark, data, tmp_path, monkeypatch):
    vec, _, _, _ = data
    fitted = models.fit_forest_grid(vec, "y", ({"trees": 6, "depth": 5, "min_split": 5},))[0]
    path = str(tmp_path / "blocks")
    fitted.model.write().overwrite().save(path)
    leaves = trees.read_leaves(spark, path, "forest")
    doubled = vec.where("k < 40").unionByName(vec.where("k < 3"))
    order = lambda df: sorted((r["k"], r["shap_values"]) for r in df.collect())
    one = order(trees.tree_shap_rows(doubled, "k", leaves))
    monkeypatch.setattr(trees, "LEAVES_PER_BLOCK", 7)
    monkeypatch.setattr(trees, "ROWS_PER_BLOCK", 9)
    many = order(trees.tree_shap_rows(doubled, "k", leaves))
    assert len(many) == 43 and all(a[0] == b[0] and np.allclose(a[1], b[1], atol=1e-12) for a, b in zip(one, many))
    assert trees.tree_shap_rows(vec.where("k < 0"), "k", leaves).collect() == []


def test_display_names(spark):
    names = {"num__bun_last": "BUN (Last)", "heartrate_std": "Heart Rate (Std Dev)", "age_gt89": "Age > 89 flag",
             "cat__gender_Male": "Gender: Male", "ph_count": "Arterial pH (Count)", "lab_measurement_count": "Total Lab Measurements",
             "unitadmitsource_Step-Down": "Admit Source: Step-Down", "sodium_slope": "Sodium (Slope)",
             "something_else_here": "Something Else Here"}
    df = spark.createDataFrame([(k,) for k in names], "f string")
    got = {r[0]: r[1] for r in df.select("f", attribution.display_name(F.col("f"))).collect()}
    assert got == names


def test_case_studies_leave_empty_quadrants_out(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (2, 1, 0.95), (3, 0, 0.1), (4, 0, 0.05), (5, 0, 0.05)], "k int, y int, p double")
    got = {r["quadrant"]: r["k"] for r in attribution.case_studies(df, "k", "y", "p", 0.5).collect()}
    assert got == {"TP": 2, "TN": 4}


def test_attributions_by_pattern_are_those_by_row(monkeypatch):
    rng = np.random.default_rng(3)
    leaves = []
    for m in (0, 1, 3, 9, 16, 33):
        low = np.where(rng.random(m) < 0.3, -np.inf, rng.normal(size=m) - 0.8)
        high = np.where(np.isinf(low) | (rng.random(m) < 0.5), low.clip(-1) + 1.0, np.inf)
        leaves.append(trees.Leaf(rng.permutation(40)[:m], low, high, rng.uniform(0.1, 0.9, m), float(rng.normal())))
    x = rng.normal(size=(1500, 40))
    calls, by_pattern = [], trees._by_pattern
    monkeypatch.setattr(trees, "_by_pattern", lambda *a: calls.append(len(a[0])) or by_pattern(*a))
    got = trees.shap_matrix(x, leaves)
    assert calls == [1500]
    want = np.vstack([trees.shap_matrix(x[i:i + 500], leaves) for i in range(0, 1500, 500)])
    assert len(calls) == 1 and np.allclose(got, want, rtol=1e-9, atol=1e-12)


def test_a_forest_is_the_same_in_place_and_by_shared_counts(spark, data, monkeypatch):
    vec = data[0]
    grid = ({"trees": 3, "depth": 3, "min_split": 5}, {"trees": 5, "depth": None, "min_split": 5}, {"trees": 2, "depth": 4, "min_split": 10})
    text = lambda fits: [f.model.toDebugString.split("\n", 1)[1] for f in fits]
    monkeypatch.setattr(forest, "ROWS_PER_BLOCK", 37)
    alone = [text(models.fit_forest_grid(vec, "y", (g,)))[0] for g in grid[:2]]
    together = models.fit_forest_grid(vec, "y", grid)
    assert text(together)[:2] == alone and [f.model.getNumTrees for f in together] == [3, 5, 2]
    passes, split = [], forest.split_frontiers
    monkeypatch.setattr(forest, "split_frontiers", lambda *a: passes.append(1) or split(*a))
    monkeypatch.setattr(forest, "GROUP_BYTES", 10 * 150)
    monkeypatch.setattr(forest, "SHIP_LEVEL", 2)
    monkeypatch.setattr(forest, "SHIP_BYTES", 10 * 900)
    assert text(models.fit_forest_grid(vec, "y", grid)) == text(together) and len(passes) > 1


def test_a_forest_splits_as_gini_asks(spark):
    """Without drawn columns and rows, the root is the best of all splits, and leaves hold weighted shares."""
    rng = np.random.default_rng(5)
    bins, y = rng.integers(0, 6, (400, 3)).astype(np.uint8), (rng.random(400) < 0.4).astype(np.uint8)
    y[bins[:, 1] > 3] = 1
    rule = forest.Rule(1, (0.8, 1.4), 3, 3)
    path, sums, feature, at = forest.in_place(bins, y, np.ones(400, np.uint8), np.array([1]), np.zeros(400, int), forest.Growth(0, 5, 3), rule)

    def purity(rows):
        a, b = 0.8 * (rows == 0).sum(), 1.4 * (rows == 1).sum()
        return (a * a + b * b) / max(a + b, 1e-300)

    best = max(((purity(y[bins[:, f] <= b]) + purity(y[bins[:, f] > b]), -f, -b) for f in range(3) for b in range(5)))
    assert (feature[0], at[0]) == (-best[1], -best[2]) and tuple(sums[0]) == ((y == 0).sum(), (y == 1).sum())
    leaf = (feature < 0)
    assert sums[leaf].sum() == 400 and (sums[leaf].sum(axis=1) >= 5).all() and path.max() < 16


# --- persistence and streaming --------------------------------------------------------------------

def test_scores_after_reload_and_in_a_stream(spark, data, tmp_path):
    _, _, _, df = data
    raw = df.withColumns({"available_lab_count": (F.col("k") % 16).cast("int"), "available_vital_count": F.lit(5),
                          "missing_feature_count": F.lit(10)})
    encoder = split.fit_encoder(raw, ["a", "b", "c", "d"], [])
    rows = encoder.encode(raw, ["k", "y"])
    fitted = models.fit_logistic_grid(rows, "y", (1.0,))[0]
    platt = models.fit_platt(models.margin(fitted, rows, "m"), "y", "m")
    artifacts = Artifacts(encoder, fitted, platt, bootstrap.fit_ensemble(rows, "k", "y", resamples=3),
                          reliability.Thresholds(0.03, 0.5), 111, "k")
    path = str(tmp_path / "artifacts")
    artifacts.save(spark, path)
    loaded = Artifacts.load(spark, path)
    batch = score_new(raw, artifacts)
    assert {r["decision"] for r in batch.collect()} == {"ACCEPT", "ABSTAIN"}

    source, sink, counts = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "counts")
    raw.where("k < 400").repartition(3).write.parquet(source)

    def run():
        assert score_stream(spark, source, raw.schema, loaded, sink, str(tmp_path / "cp"), counts=counts).awaitTermination(120)

    run()
    # The sink has the batch, but a crash kept it from being committed: it runs again.
    for name in ("0", ".0.crc"):
        (tmp_path / "cp" / "commits" / name).unlink(missing_ok=True)
    run()
    assert spark.read.parquet(sink).count() == 400
    raw.where("k >= 400").write.mode("append").parquet(source)
    run()
    streamed = spark.read.parquet(sink)
    assert {r["batch"] for r in streamed.select("batch").distinct().collect()} == {0, 1}
    held = {(r["batch"], r["decision"]): r["n"] for r in spark.read.parquet(counts).collect()}
    assert held == {(r["batch"], r["decision"]): r["count"] for r in streamed.groupBy("batch", "decision").count().collect()}
    streamed = streamed.drop("batch")
    join = batch.alias("a").join(streamed.alias("b"), "k").select(
        F.max(F.abs(F.col("a.p") - F.col("b.p"))), F.max(F.abs(F.col("a.boot_std") - F.col("b.boot_std"))),
        F.count(F.lit(1)), F.count_if(F.col("a.decision") == F.col("b.decision"))).first()
    assert join[0] < 1e-12 and join[1] < 1e-12 and join[2] == join[3] == 600


def test_fits_do_not_depend_on_how_rows_arrive(spark, data):
    df = data[3]
    rows = split.fit_encoder(df, ["a", "b", "c", "d"], []).encode(df, ["k", "y"])
    grid = ({"trees": 5, "depth": 3, "min_split": 2},)
    boosted = ({"trees": 3, "depth": 2, "rate": 0.1, "rows": 0.8, "columns": 1.0},)
    for fit, settings in ((models.fit_forest_grid, grid), (models.fit_boosted_grid, boosted)):
        one, seven = (fit(rows.repartition(n), "y", settings)[0].model.toDebugString.split("\n", 1)[1] for n in (1, 7))
        assert one == seven


def test_training_partitions_follow_the_rows(spark, data, monkeypatch):
    vec = data[0]
    parts = lambda df: df.select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts(models.training_rows(vec)) == 4
    monkeypatch.setattr(models, "ROWS_PER_PARTITION", 50)
    laid = models.training_rows(vec)
    assert 4 < parts(laid) <= 12
    assert laid.exceptAll(vec).count() == 0 and laid.count() == 600
