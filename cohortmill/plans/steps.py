"""Composed plans: from raw tables to features, models, explanations and decisions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, functions as F

from cohortmill import presets
from cohortmill.config import Preset
from cohortmill.functions.columns import unit_hash
from cohortmill.operators import attribution, clean, cohort, measures, models, profile, reliability, split, trees
from cohortmill.operators.boosting import BoostedTrees
from cohortmill.operators.bootstrap import Ensemble, fit_ensemble
from cohortmill.session import materialize, written
from cohortmill.streaming.score import Artifacts


@dataclass(frozen=True)
class Tables:
    """The three input tables."""

    patient: DataFrame
    lab: DataFrame
    vital: DataFrame


def validate_dataset(tables: Tables, preset: Preset, strict: bool = True) -> dict[str, DataFrame]:
    """All validation and profiling tables of a raw data set."""
    r = preset.roles
    patient, lab, vital = tables.patient, tables.lab, tables.vital
    flags = profile.quality_flags(preset, patient, lab, vital)
    signals = [b.name for b in preset.wide_bounds]
    return {
        "schema_check": profile.schema_check({"patient": patient, "lab": lab, "vitalPeriodic": vital},
                                             preset.required, strict),
        "identifier_validation": profile.identifier_validation(preset, patient, lab, vital),
        "orphan_records": profile.orphan_records(lab, patient, r.entity, "lab").unionByName(
            profile.orphan_records(vital, patient, r.entity, "vital")),
        "target_distribution": profile.outcome_distribution(patient, r.outcome),
        "temporal_summary": profile.temporal_summary(lab, r.long_offset, "lab", preset.window).unionByName(
            profile.temporal_summary(vital, r.wide_offset, "vital", preset.window)),
        "missingness": profile.missingness(patient, patient.columns, "patient").unionByName(
            profile.missingness(vital, signals, "vital")),
        "lab_missingness": profile.long_missingness(lab, r.long_name, r.long_value,
                                                    [b.name for b in preset.long_bounds]),
        "plausibility_wide": profile.plausibility_wide(vital, preset.wide_bounds),
        "plausibility_long": profile.plausibility_long(lab, r.long_name, r.long_value, preset.long_bounds),
        "quality_flags": flags,
        "quality_flag_summary": profile.flag_summary(flags),
        "validated_patient": patient.join(flags, r.entity, "left"),
        "validated_lab": clean.time_flags(lab, r.long_offset, preset.window),
        "validated_vital": clean.time_flags(vital, r.wide_offset, preset.window),
    }


def select_cohort(patient: DataFrame, preset: Preset, strategy: str = "visit_number") -> DataFrame:
    """Known outcome, harmonised age, index stay, landmark."""
    r = preset.roles
    aged = clean.harmonize_age(clean.encode_outcome(patient, r.outcome), r.age, r.age_capped_text, r.age_capped_value)
    if strategy == "visit_number":
        index = cohort.index_by_visit(aged, r.visit)
    elif strategy == "first_per_encounter":
        index = cohort.index_by_order(aged, r.encounter, r.index_order)
    else:
        raise ValueError(f"unknown index strategy {strategy!r}")
    return cohort.landmark(index, r.duration, preset.landmark)


def window_rows(tables: Tables, keys: DataFrame, preset: Preset, check: bool = False) -> tuple[DataFrame, DataFrame]:
    """(labs, vitals) of the cohort inside the window, as measured."""
    r, w = preset.roles, preset.window
    labs = cohort.extract_window(tables.lab, keys, r.entity, r.long_offset, w)
    vitals = cohort.extract_window(tables.vital, keys, r.entity, r.wide_offset, w)
    if check:
        labs = cohort.assert_inside(labs, r.long_offset, w)
        vitals = cohort.assert_inside(vitals, r.wide_offset, w)
    return labs, vitals


def window_and_mask(tables: Tables, keys: DataFrame, preset: Preset, check: bool = False) -> tuple[DataFrame, DataFrame]:
    """(labs, vitals) of the cohort inside the window with implausible values nulled."""
    r = preset.roles
    labs, vitals = window_rows(tables, keys, preset, check)
    return (clean.mask_long(labs, r.long_name, r.long_value, preset.long_bounds),
            clean.mask_wide(vitals, preset.wide_bounds))


def build_cohort(tables: Tables, preset: Preset, strategy: str = "visit_number") -> dict[str, DataFrame]:
    """Cohort, cleaned measurements, audit of the cleaning, reports and coverage."""
    r = preset.roles
    entities = select_cohort(tables.patient, preset, strategy)
    keys = written(entities.select(r.entity))
    labs, vitals = window_and_mask(tables, keys, preset)
    size = keys.agg(F.count(F.lit(1)).alias("n"))
    encoded = clean.encode_outcome(tables.patient, r.outcome)
    index = cohort.index_by_visit(encoded, r.visit) if strategy == "visit_number" else cohort.index_by_order(
        encoded, r.encounter, r.index_order)
    return {
        "cohort": entities, "labs": labs, "vitals": vitals,
        "cleaning_audit": profile.cleaning_audit(*window_rows(tables, keys, preset), preset),
        "outcome_report": cohort.outcome_report(tables.patient, r.outcome),
        "index_report": (cohort.index_report_by_visit(encoded, r.visit, r.outcome.label) if strategy == "visit_number"
                         else cohort.index_report_by_order(encoded, r.encounter, r.index_order, r.outcome.label)),
        "landmark_report": cohort.landmark_report(index, r, preset.landmark),
        "attrition": cohort.attrition_flow(tables.patient, r, preset.landmark, strategy == "first_per_encounter"),
        "coverage": cohort.coverage(labs, r.entity, size, "lab").unionByName(
            cohort.coverage(vitals, r.entity, size, "vital")),
    }


def write_cohort(tables: Tables, preset: Preset, path: str, strategy: str = "visit_number") -> dict[str, DataFrame]:
    """Write the cohort and its cleaned measurements below ``path`` and report on them, reading each raw table once.

    Rows, rows outside the window and what masking nulls are observed while the
    tables are written. The audit of names, whose values stay beside the masked
    ones, and the coverage read the written tables. Rows outside the window are
    an error. Returns cohort, labs, vitals, cleaning_audit, coverage, invariants
    (table_name, rows, before, after).
    """
    r, w = preset.roles, preset.window
    spark = tables.patient.sparkSession
    select_cohort(tables.patient, preset, strategy).write.mode("overwrite").parquet(f"{path}/cohort")
    entities = spark.read.parquet(f"{path}/cohort")
    labs, vitals = window_rows(tables, entities.select(r.entity), preset)
    seen: dict[str, dict[str, int]] = {}

    def write(name: str, rows: DataFrame, offset: str, mask: Callable[[DataFrame], DataFrame], metrics: list[Column]) -> DataFrame:
        observed = Observation(name)
        time = F.col(offset)
        mask(rows.observe(observed, F.count(F.lit(1)).alias("rows"), F.count_if(time < w.start).alias("before"),
                          F.count_if(time > w.end).alias("after"), *metrics)).write.mode("overwrite").parquet(f"{path}/{name}")
        seen[name] = observed.get
        if seen[name]["before"] or seen[name]["after"]:
            raise ValueError(f"{name}: {seen[name]['before']} rows before and {seen[name]['after']} rows after the window")
        return spark.read.parquet(f"{path}/{name}")

    done_labs = write("labs", labs, r.long_offset,
                      lambda df: clean.mask_long(df, r.long_name, r.long_value, preset.long_bounds), [])
    done_vitals = write("vitals", vitals, r.wide_offset, lambda df: clean.mask_wide(df, preset.wide_bounds),
                        profile.plausibility_counts(vitals, preset.wide_bounds))
    counted = spark.createDataFrame([tuple(seen["vitals"].values())], ", ".join(f"`{k}` bigint" for k in seen["vitals"]))
    size = entities.agg(F.count(F.lit(1)).alias("n"))
    return {
        "cohort": entities, "labs": done_labs, "vitals": done_vitals,
        "cleaning_audit": profile.cleaning_audit(done_labs, vitals, preset, counted),
        "coverage": cohort.coverage(done_labs, r.entity, size, "lab").unionByName(
            cohort.coverage(done_vitals, r.entity, size, "vital")),
        "invariants": spark.createDataFrame([(n, v["rows"], v["before"], v["after"]) for n, v in seen.items()],
                                            "table_name string, rows bigint, before bigint, after bigint"),
    }


def build_features(tables: Tables, preset: Preset, strategy: str = "visit_number",
                   reduce_first: bool = False, check: bool = True) -> DataFrame:
    """One feature row per cohort entity.

    With ``check`` a repeated entity, a label outside 0/1 or a column that gives
    the outcome away is an error; the first two are read off the cohort alone,
    since every other side of the joins has one row per entity.

    The cohort's keys are written, and by their bytes Spark decides whether they
    filter the measurements at the scan. With ``reduce_first`` the measurements
    are reduced to one row per entity before they meet the cohort, so that raw
    rows are never shuffled by entity: for cohorts that hold most entities.
    """
    r, f, w = preset.roles, preset.features, preset.window
    entities = select_cohort(tables.patient, preset, strategy)
    admission = measures.admission_features(entities, f)
    groups = measures.feature_groups(f)
    if check:
        leaking = profile.leaking_columns([c for columns in groups.values() for c in columns])
        if leaking:
            raise ValueError(f"columns give the outcome away: {leaking}")
        profile.require_model_table(profile.model_table_report(admission, r.entity, f.target, groups))
    labs = clean.in_window(tables.lab, r.long_offset, w)
    vitals = clean.in_window(tables.vital, r.wide_offset, w)
    if not reduce_first:
        keys = written(entities.select(r.entity))
        labs, vitals = cohort.restrict_to(labs, keys, r.entity), cohort.restrict_to(vitals, keys, r.entity)
    wide = measures.wide_features(clean.mask_wide(vitals, preset.wide_bounds), r.entity, f.wide)
    long = measures.long_features(clean.mask_long(labs, r.long_name, r.long_value, preset.long_bounds),
                                  r.entity, r.long_name, "labresult_num", r.long_offset, r.long_order, f.long)
    return measures.assemble(admission, wide, long, r.entity, f)


def feature_columns(df: DataFrame, preset: Preset) -> list[str]:
    f = preset.features
    banned = {*f.identifiers, f.target, preset.roles.person, "split", "fold"}
    columns = [c for c in df.columns if c not in banned]
    leaking = profile.leaking_columns(columns)
    if leaking:
        raise ValueError(f"columns give the outcome away: {leaking}")
    return columns


@dataclass(frozen=True)
class Training:
    """Split, encoded rows with the fitted preprocessing and candidates."""

    rows: DataFrame
    encoder: split.Encoder
    candidates: list[models.Fitted]
    records: DataFrame
    best: dict[str, models.Fitted]

    def part(self, name: str) -> DataFrame:
        return self.rows.where(F.col("split") == name)


def split_and_encode(features: DataFrame, entities: DataFrame, preset: Preset, seed: int = 42,
                     packed: bool = False) -> tuple[DataFrame, split.Encoder]:
    """Encoded rows (key, person, split, label, features); preprocessing is fitted on train only.

    ``packed`` balances the folds on rows and positives even if groups differ much in size.
    """
    r, f = preset.roles, preset.features
    columns = feature_columns(features, preset)
    numeric, categorical = split.split_types(features, columns)
    rows = split.lookup_group(features, entities, r.entity, r.person)
    folds = (split.packed_folds if packed else split.group_folds)(rows, r.person, f.target, seed=seed)
    placed = materialize(split.with_split(rows, folds, r.person, r.entity, seed=seed))
    split.require_disjoint(placed, r.person)
    encoder = split.fit_encoder(placed.where("split = 'train'"), numeric, categorical)
    encoded = encoder.encode(placed, [r.entity, r.person, "split", f.target])
    return materialize(encoded), encoder


def train_candidates(features: DataFrame, entities: DataFrame, preset: Preset, seed: int = 42,
                     logistic_grid=presets.LOGISTIC_GRID, forest_grid=presets.FOREST_GRID,
                     boosted_grid=presets.BOOSTED_GRID, parallelism: int = 8, second_order: bool = True,
                     packed: bool = False) -> Training:
    """Fit every candidate of the three families and rank them on validation.

    Boosted trees are second-order ones with shrunk Newton leaves, or Spark's own.
    """
    target = preset.features.target
    rows, encoder = split_and_encode(features, entities, preset, seed, packed)
    train = rows.where("split = 'train'")
    candidates = (models.fit_logistic_grid(train, target, logistic_grid, parallelism)
                  + models.fit_forest_grid(train, target, forest_grid, seed, parallelism)
                  + (models.fit_newton_grid(train, target, boosted_grid, seed) if second_order
                     else models.fit_boosted_grid(train, target, boosted_grid, seed, parallelism)))
    records = materialize(models.search_records(candidates, rows.where("split = 'validation'"), target))
    return Training(rows, encoder, candidates, records, models.best_of_families(candidates, records))


@dataclass(frozen=True)
class Calibrated:
    """Scores of all variants, their catalog, and the model and variant that are chosen."""

    scores: DataFrame
    catalog: DataFrame
    scorecard: DataFrame
    platts: dict[str, models.Platt]
    isotonics: dict[str, object]
    family: str = ""
    variant: str = ""


def for_calibrating(person: str, key: str, seed: int = 42) -> Column:
    """Whether a validation row calibrates (half of the persons) or selects (the others)."""
    who = F.coalesce(F.col(person).cast("string"), F.concat(F.lit("key:"), F.col(key).cast("string")))
    return unit_hash(F.lit(f"{seed}:half"), who) < 0.5


def calibrate_and_select(training: Training, preset: Preset, split_for_score: str = "val", seed: int = 42,
                         pin: str | None = None) -> Calibrated:
    """Calibrate each family's best model, score all nine variants and choose one.

    Calibrators are fitted on one half of the validation persons; catalog,
    scorecard and choice see the other half only, so no row both fits a
    calibrator and judges it. ``scores`` holds the selecting half and the test
    rows; ``split`` names the calibrating half "calibration".
    """
    key, target, person = preset.roles.entity, preset.features.target, preset.roles.person
    platts, isotonics = {}, {}
    parts = None
    held = training.rows.where("split in ('validation', 'test')")
    for family, fitted in training.best.items():
        scored = materialize(models.margin(fitted, models.probability(fitted, held, "p_raw"), "m")
                             .withColumn("split", F.when((F.col("split") == "validation") & for_calibrating(person, key, seed),
                                                         "calibration").otherwise(F.col("split")))
                             .select(key, "split", F.col(target).alias("y"), "p_raw", "m"))
        val = scored.where("split = 'calibration'")
        platts[family] = models.fit_platt(val, "y", "m")
        isotonics[family] = models.fit_isotonic(val, "y", "m")
        iso = models.apply_isotonic(isotonics[family], scored, "m", "p_iso")
        part = iso.select(key, "split", "y", F.lit(family).alias("model"), F.inline(F.array(
            F.struct(F.lit("uncalibrated").alias("variant"), F.col("p_raw").alias("p")),
            F.struct(F.lit("sigmoid_platt").alias("variant"), platts[family].apply(F.col("m")).alias("p")),
            F.struct(F.lit("isotonic").alias("variant"), F.col("p_iso").alias("p")))))
        parts = part if parts is None else parts.unionByName(part)
    catalog = materialize(models.evaluation_catalog(parts))
    scorecard = materialize(models.model_scorecard(catalog, split_for_score))
    best = models.champion(scorecard, pin).first()
    return Calibrated(parts, catalog, scorecard, platts, isotonics, best["model"], best["best_variant"])


def explain_scores(rows: DataFrame, fitted: models.Fitted, names: list[str], key: str, model_path: str,
                   k: int = 5) -> dict[str, DataFrame]:
    """Attributions of a tree model with global and local summaries; saves the model first."""
    spark = rows.sparkSession
    if isinstance(fitted.model, BoostedTrees):
        fitted.model.save(spark, model_path)
        leaves = BoostedTrees.leaves(spark, model_path)
    else:
        fitted.model.write().overwrite().save(model_path)
        leaves = trees.read_leaves(spark, model_path, fitted.family)
    attributed = materialize(trees.tree_shap_rows(rows, key, leaves))
    long = attribution.long_contributions(attributed, key, names)
    local = attribution.local_from_rows(attributed, key, names, k)
    return {"contributions": long, "global_importance": attribution.global_importance(long),
            "local_contributions": local, "drivers": attribution.driver_names(local, key)}


def reliability_layer(training: Training, calibrated: Calibrated, features: DataFrame, flags: DataFrame | None,
                      preset: Preset, family: str | None = None, variant: str | None = None, resamples: int = 30,
                      min_coverage: float = 0.60, seed: int = 42, local: DataFrame | None = None,
                      metadata: tuple[str, ...] = ()) -> tuple[dict[str, DataFrame], Artifacts]:
    """Ensemble spread, quality score, frozen thresholds and their evaluation on test.

    The ensemble is fitted once and used for validation, test and new rows. The
    model and variant are those chosen by ``calibrate_and_select`` unless named.
    ``scored`` and thresholds use all validation rows, as thresholds need no
    calibrator of their own. The report's records also hold the person, the
    recorded outcome, the counts behind the quality score, the feature columns
    in ``metadata`` and, where ``local`` (the local contributions of
    ``explain_scores``) has the row, its strongest features of either direction.
    """
    family, variant = family or calibrated.family, variant or calibrated.variant
    key, target = preset.roles.entity, preset.features.target
    ensemble: Ensemble = fit_ensemble(training.part("train"), key, target, resamples, seed)
    held = training.rows.where("split in ('validation', 'test')").select(key, "split", target, "features")
    total = len(measures.clinical_columns(preset.features))
    shares = reliability.passed_share(flags, key) if flags is not None else None
    quality = reliability.data_quality_score(features, key, shares, total).select(key, "data_quality_score")
    p = calibrated.scores.where((F.col("model") == family) & (F.col("variant") == variant)).select(key, "p")
    scored = materialize(ensemble.spread(held).drop("features").join(quality, key).join(p, key)
                         .withColumnRenamed(target, "y"))
    args = ("y", "p", "boot_std", "data_quality_score")
    thresholds = reliability.choose_thresholds(scored.where("split = 'validation'"), *args, min_coverage=min_coverage)
    test = scored.where("split = 'test'")
    extras = ["available_lab_count", "available_vital_count", "missing_feature_count", *metadata]
    records = test.join(features.select(key, *extras), key).join(
        training.part("test").select(key, preset.roles.person), key)
    extras = [preset.roles.person, "y", *extras]
    if local is not None:
        records = records.join(local.select(key, "top_increasing", "top_decreasing"), key, "left")
        extras += ["top_increasing", "top_decreasing"]
    tables = {
        "scored": scored,
        "strategy_metrics": reliability.evaluate_strategies(test, *args, thresholds),
        "risk_coverage": reliability.risk_coverage(test, *args),
        "reliability_report": reliability.reliability_report(records, key, "p", "boot_mean", "boot_std",
                                                             "data_quality_score", thresholds, extras),
        "abstain_profile": reliability.abstain_profile(test, "boot_std", "data_quality_score", thresholds),
    }
    return tables, Artifacts(training.encoder, training.best[family], calibrated.platts[family], ensemble,
                             thresholds, total, key, variant, calibrated.isotonics[family],
                             "passed_share" if flags is not None else "")


def dashboard_tables(features: DataFrame, flags: DataFrame, preset: Preset) -> dict[str, DataFrame]:
    """Aggregates behind the overview and data-quality pages."""
    f, r = preset.features, preset.roles
    missing = profile.missingness(features, measures.clinical_columns(f), "features")
    numeric, categorical = split.split_types(features, feature_columns(features, preset))
    return {
        "kpi_summary": profile.kpi_summary(features, len(f.long), len(f.wide)),
        "rate_by_category": profile.rate_by_category(features, "unittype", f.target),
        "age_histogram": profile.histogram(features, "age_numeric", 0.0, 100.0, 25),
        "missingness_bands": profile.missingness_bands(missing),
        "missingness_totals": profile.missingness_totals(missing),
        "clean_entities": profile.clean_entities(flags, r.entity, profile.FLAGS[0], presets.CLEAN_WORDS),
        "baseline_profile": profile.baseline_profile(features, numeric, categorical),
    }
