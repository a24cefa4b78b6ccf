"""Composed plans, sources and sinks, and the shape of physical plans."""

import re

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F, types as T

from checks.registry import FEATURES, P, R, tables
from checks.views import view
from cohortmill import presets
from cohortmill.operators import attribution, clean, cohort, curves, measures, models, profile, reliability, split
from cohortmill.plans import steps
from cohortmill.sources import readers, sinks
from cohortmill.streaming.score import Artifacts, score_new


def physical(df) -> str:
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "10000")
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def inputs(spark, sf):
    return tables(spark, sf)


@pytest.fixture(scope="module")
def features(spark, sf, inputs):
    return steps.materialize(steps.build_features(inputs, P))


# --- compositions -----------------------------------------------------------------------------

def test_validation_tables(inputs):
    out = steps.validate_dataset(inputs, P)
    assert out["schema_check"].where("status = 'PASS'").count() == 3
    n = inputs.patient.count()
    assert out["quality_flags"].count() == n == out["validated_patient"].count()
    assert out["validated_lab"].count() == inputs.lab.count()
    assert out["missingness"].count() == len(inputs.patient.columns) + 7
    assert all(df.columns for df in out.values())
    assert out["plausibility_wide"].count() == 7 and out["quality_flag_summary"].count() == 6


@pytest.mark.parametrize("strategy", ["visit_number", "first_per_encounter"])
def test_cohort_counts_agree(inputs, strategy):
    out = steps.build_cohort(inputs, P, strategy)
    size = out["cohort"].count()
    index, land = out["index_report"].first(), out["landmark_report"].first()
    assert land["eligible"] == size and index["retained"] == land["initial_stays"]
    assert out["labs"].where(~F.col(R.long_offset).between(0, 1440)).count() == 0
    assert out["vitals"].where(F.col("sao2") > 100).count() == 0
    assert out["coverage"].count() == 2
    assert out["attrition"].orderBy("step_no").collect()[-1]["n"] == size


def test_unknown_strategy_raises(inputs):
    with pytest.raises(ValueError):
        steps.select_cohort(inputs.patient, P, "other")


def test_features_are_the_same_for_small_and_large_cohorts(inputs, features):
    large = steps.build_features(inputs, P, reduce_first=True)
    assert features.columns == large.columns
    exact = [c for c in features.columns if not c.endswith(("_mean", "_std"))]
    assert features.select(exact).exceptAll(large.select(exact)).count() == 0
    gaps = features.alias("a").join(large.alias("b"), R.entity).agg(*[
        F.max(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}"))).alias(c) for c in features.columns if c.endswith(("_mean", "_std"))]).first()
    assert all(g is None or g < 1e-9 for g in gaps)


def test_training_to_reliability(spark, inputs, features, tmp_path):
    entities = steps.select_cohort(inputs.patient, P)
    training = steps.train_candidates(
        features, entities, P, logistic_grid=(0.01, 0.1), forest_grid=({"trees": 5, "depth": 3, "min_split": 5},),
        boosted_grid=({"trees": 5, "depth": 2, "rate": 0.1, "rows": 1.0, "columns": 1.0},))
    assert training.records.count() == 4 and set(training.best) == {"logistic", "forest", "boosted"}
    assert split.split_overlap(training.rows, R.person).agg(F.sum("shared_persons")).first()[0] == 0
    assert len(training.encoder.names) == len(training.rows.first()["features"])

    calibrated = steps.calibrate_and_select(training, P)
    assert calibrated.catalog.count() == 9 and calibrated.scorecard.count() == 3
    assert calibrated.scores.where("p < 0 or p > 1 or p is null").count() == 0
    assert models.champion(calibrated.scorecard, "boosted").first()["model"] == "boosted"

    explained = steps.explain_scores(training.part("test"), training.best["boosted"], training.encoder.names, R.entity,
                                     str(tmp_path / "boosted"))
    importance = explained["global_importance"].orderBy("rank").collect()
    assert importance[-1]["cumulative_pct"] == pytest.approx(100.0)
    local = explained["local_contributions"]
    assert local.where(F.abs(F.col("margin") - F.col("base_value") - F.col("total_shap")) > 1e-9).count() == 0
    assert local.where(F.size("top_increasing") > 5).count() == 0

    flags = profile.quality_flags(P, inputs.patient, inputs.lab, inputs.vital)
    fits, selects = (calibrated.scores.where(F.col("split") == s).select(R.entity) for s in ("calibration", "validation"))
    assert fits.count() > 0 < selects.count() and fits.intersect(selects).count() == 0
    assert calibrated.catalog.where("val_ece = 0").count() == 0
    chosen = models.champion(calibrated.scorecard).first()
    assert (calibrated.family, calibrated.variant) == (chosen["model"], chosen["best_variant"])
    out, artifacts = steps.reliability_layer(training, calibrated, features, flags, P, resamples=4, local=local,
                                             metadata=("age_numeric", "unittype"))
    record = out["reliability_report"].first().asDict()
    assert {R.person, "y", "available_lab_count", "missing_feature_count", "age_numeric", "unittype"} <= set(record)
    assert record["top_increasing"] is not None and out["reliability_report"].count() == training.part("test").count()
    drivers = explained["drivers"].join(attribution.driver_text(explained["contributions"], R.entity).withColumnsRenamed(
        {"increasing": "i", "decreasing": "d"}), R.entity)
    assert drivers.count() == local.count() and drivers.where("increasing <> i or decreasing <> d").count() == 0
    assert (artifacts.fitted, artifacts.variant) == (training.best[calibrated.family], calibrated.variant)
    for variant in ("uncalibrated", "sigmoid_platt", "isotonic"):
        tables_out, frozen = steps.reliability_layer(training, calibrated, features, flags, P, "logistic", variant, resamples=2)
        frozen.save(spark, str(tmp_path / variant))
        with pytest.raises(ValueError):
            score_new(features, frozen)
        new = score_new(features, Artifacts.load(spark, str(tmp_path / variant)), flags)
        both = tables_out["reliability_report"].alias("a").join(new.alias("b"), R.entity)
        assert both.count() == tables_out["reliability_report"].count()
        assert both.where("abs(a.probability - b.p) > 1e-9 or abs(a.data_quality_score - b.data_quality_score) > 1e-12 "
                          "or a.decision <> b.decision or a.reasons <> b.reasons").count() == 0
    strategies = {r["strategy"]: r for r in out["strategy_metrics"].collect()}
    assert strategies["model_only"]["coverage"] == 1.0
    assert strategies["combined"]["n_accepted"] <= min(strategies["dq_abstain"]["n_accepted"],
                                                       strategies["uncertainty_abstain"]["n_accepted"])
    report = out["reliability_report"]
    assert report.where("decision = 'ACCEPT' and size(reasons) > 0").count() == 0
    assert report.where("decision = 'ABSTAIN' and size(reasons) = 0").count() == 0
    assert 0 < artifacts.ensemble.size <= 4


def test_written_cohort_reports_what_it_wrote(spark, inputs, tmp_path, monkeypatch):
    """The observed reports equal those taken from the tables, and a raw table is read once."""
    plain = steps.build_cohort(inputs, P)
    scans = {"lab": spark.sparkContext.accumulator(0), "vital": spark.sparkContext.accumulator(0)}

    def watched(df, name):
        def count(batches):
            for batch in batches:
                scans[name].add(batch.num_rows)
                yield batch
        return df.mapInArrow(count, df.schema)

    tables = steps.Tables(inputs.patient, watched(inputs.lab, "lab"), watched(inputs.vital, "vital"))
    out = steps.write_cohort(tables, P, str(tmp_path / "cohort"))
    assert scans["lab"].value == inputs.lab.count() and scans["vital"].value == inputs.vital.count()
    for name in ("cleaning_audit", "coverage", "labs", "vitals", "cohort"):
        got, want = out[name].select(*plain[name].columns), plain[name]
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    held = {r["table_name"]: r for r in out["invariants"].collect()}
    assert held["labs"]["rows"] == out["labs"].count() and held["vitals"]["before"] == held["vitals"]["after"] == 0
    monkeypatch.setattr(steps, "window_rows", lambda t, keys, preset: (t.lab, t.vital))
    with pytest.raises(ValueError):
        steps.write_cohort(inputs, P, str(tmp_path / "unwindowed"))


def test_dashboard(inputs, features):
    flags = profile.quality_flags(P, inputs.patient, inputs.lab, inputs.vital)
    out = steps.dashboard_tables(features, flags, P)
    assert out["kpi_summary"].first()["entities"] == features.count()
    assert out["age_histogram"].agg(F.sum("n")).first()[0] == features.where("age_numeric is not null").count()
    assert out["baseline_profile"].count() > 100


def test_plan_tables_are_written(spark, tmp_path, inputs):
    out = steps.build_cohort(inputs, P)
    folders = sinks.write_tables({k: out[k] for k in ("cohort", "cleaning_audit", "coverage")}, str(tmp_path / "t"), ("coverage",))
    for name in ("cohort", "cleaning_audit"):
        back = readers.read_parquet(spark, folders[name])
        assert back.columns == out[name].columns and back.exceptAll(out[name]).count() == 0 == out[name].exceptAll(back).count()
    assert {r["table_name"] for r in readers.read_json_metrics(spark, folders["coverage"], lines=True).collect()} == {"lab", "vital"}
    audit = out["cleaning_audit"].where("table_name = 'vital' and name = 'sao2'").first()
    raw = steps.window_rows(inputs, out["cohort"].select(R.entity), P)[1]
    assert audit["nullified"] == raw.where("sao2 < 50 or sao2 > 100").count() > 0
    assert audit["total_non_null"] - audit["nullified"] == out["vitals"].where("sao2 is not null").count()


def test_plan_refuses_repeated_entities(inputs):
    twice = steps.Tables(inputs.patient.unionByName(inputs.patient), inputs.lab, inputs.vital)
    with pytest.raises(ValueError, match="duplicate"):
        steps.build_features(twice, P)


def test_feature_guard(features):
    with pytest.raises(ValueError):
        steps.feature_columns(features.withColumn("unitdischargeoffset", F.lit(1)), P)


def test_local_contributions_agree_in_both_forms(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0, 3.0], [0.5, -0.25, 0.75], 0.1), (2, [0.0, 0.0, 1.0], [0.0, -0.5, -0.5], 0.1)],
                                 "k int, feature_values array<double>, shap_values array<double>, base_value double")
    names = ["a", "b", "c"]
    wide = attribution.local_from_rows(rows, "k", names, 2)
    long = attribution.local_contributions(attribution.long_contributions(rows, "k", names), "k", 2)
    columns = ["k", "base_value", "total_shap", "margin", "top_increasing", "top_decreasing"]
    assert wide.select(columns).orderBy("k").collect() == long.select(columns).orderBy("k").collect()
    assert [e["feature"] for e in wide.where("k = 1").first()["top_increasing"]] == ["c", "a"]


# --- sources and sinks --------------------------------------------------------------------------

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.DoubleType()), T.StructField("s", T.StringType()),
                       T.StructField("absent", T.StringType())])


def test_csv_is_lenient_and_matched_by_name(spark, tmp_path):
    (tmp_path / "t.csv").write_text('s,v,id\n"",1.5,1\nx,oops,2\ny,,3\n')
    got = [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "t.csv"), SCHEMA).orderBy("id").collect()]
    assert got == [(1, 1.5, None, None), (2, None, "x", None), (3, None, "y", None)]
    with pytest.raises(AnalysisException):
        readers.read_csv(spark, str(tmp_path / "absent.csv"), SCHEMA)


def test_optional_source(spark, tmp_path):
    empty = readers.try_read(spark, str(tmp_path / "nothing"), SCHEMA)
    assert empty.schema == SCHEMA and empty.count() == 0
    spark.range(3).write.parquet(str(tmp_path / "there"))
    assert readers.try_read(spark, str(tmp_path / "there"), SCHEMA).count() == 3


def test_sinks_round_trip(spark, tmp_path, inputs):
    flags = profile.quality_flags(P, inputs.patient, inputs.lab, inputs.vital)
    summary = profile.flag_summary(flags)
    sinks.write_json_metrics(summary, str(tmp_path / "m"))
    assert sorted(r["flag"] for r in readers.read_json_metrics(spark, str(tmp_path / "m"), lines=True).collect()) == sorted(profile.ALL_FLAGS)
    sinks.write_csv(summary, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 6
    sinks.write_parquet(flags, str(tmp_path / "p"), buckets=4, key=R.entity)
    back = readers.read_parquet(spark, str(tmp_path / "p"), flags.columns)
    assert back.exceptAll(flags).count() == 0 and back.count() == flags.count()
    (tmp_path / "tree.json").write_text('{"config": {"threshold": 0.5},\n "n": 3}')
    assert readers.read_json_metrics(spark, str(tmp_path / "tree.json")).select("config.threshold").first()[0] == 0.5


# --- physical plans -------------------------------------------------------------------------------

def test_lab_features_shuffle_reduced_rows_only(spark, tmp_path):
    path = str(tmp_path / "labs")
    spark.createDataFrame([(1, "sodium", 10, 1, 140.0)], "patientunitstayid long, labname string, labresultoffset long, "
                          "labid long, labresult double").write.parquet(path)
    labs = clean.mask_long(clean.in_window(spark.read.parquet(path), R.long_offset), R.long_name, R.long_value, P.long_bounds)
    plan = physical(measures.long_features(labs, R.entity, R.long_name, "labresult_num", R.long_offset, R.long_order, FEATURES.long))
    initial = plan.split("Initial Plan")[-1]
    assert initial.count("Exchange hashpartitioning") == 2
    assert re.findall(r"\w+Join", initial) == ["BroadcastHashJoin"]
    assert "partial_min_by" in initial and "SortAggregate" not in initial
    assert "GreaterThanOrEqual(labresultoffset,0)" in plan and "LessThanOrEqual(labresultoffset,1440)" in plan


def test_wide_features_prune_columns_and_shuffle_once(spark, tmp_path):
    path = str(tmp_path / "vitals")
    spark.createDataFrame([(1, 5, 80.0, "unused")], "patientunitstayid long, observationoffset long, heartrate double, note string"
                          ).write.parquet(path)
    vitals = clean.mask_wide(clean.in_window(spark.read.parquet(path), R.wide_offset), P.wide_bounds)
    plan = physical(measures.wide_features(vitals, R.entity, FEATURES.wide)).split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 1
    assert "note" not in re.findall(r"ReadSchema: (.*)", plan)[0]


def test_no_window_over_all_rows(spark, sf):
    scored = view(spark, sf, "fx_scored")
    ranked = curves.ranked_scores(scored, "y", "p", rows_per_range=50)
    plan = physical(ranked)
    windows = re.findall(r"Window \[.*", plan)
    assert windows and all("windowspecdefinition(__range" in w for w in windows)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    grouped = physical(curves.roc_points(scored, "y", "p", ["unittype"], rows_per_range=50))
    assert "SortMergeJoin" not in grouped
    folds = physical(split.group_folds(scored, "uniquepid", "y"))
    assert all("stratum" in node for node in re.findall(r"Window \[(.*?)\n", folds))


def test_grid_copies_rows_after_the_running_sums(spark, sf):
    scored = view(spark, sf, "fx_scored")
    plan = physical(reliability.threshold_grid(scored, "y", "p", "ustd", "dq", [0.1, 0.2], [0.4, 0.5], rows_per_range=100))
    below = plan[plan.index("Window ["):]
    assert "Generate inline" not in below and "Exchange hashpartitioning(__range" in below


def test_large_cohort_keeps_raw_rows_unshuffled(spark, inputs):
    plan = physical(steps.build_features(inputs, P, reduce_first=True)).split("Initial Plan")[-1]
    assert "partial_stddev_samp" in plan or "partial_avg" in plan
    assert "LeftSemi" not in plan


def test_shuffles_have_enough_partitions_to_stay_small(spark):
    # The session asks for four; adaptive execution merges what is small.
    wide = spark.range(6_000_000).select(F.xxhash64("id").alias("v")).repartition("v")
    assert wide.select(F.spark_partition_id().alias("p")).distinct().count() > 4
    assert spark.range(100).repartition("id").select(F.spark_partition_id().alias("p")).distinct().count() == 1
