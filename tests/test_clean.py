"""Literal-row cases of cleaning, cohort rules, features and profiling."""

import pytest
from pyspark.sql import functions as F

from cohortmill import presets
from cohortmill.config import Bound, ObservationWindow
from cohortmill.operators import clean, cohort, measures, profile, split
from cohortmill.session import local_session

P = presets.ICU
R = P.roles


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.fixture(scope="module")
def patients(spark):
    # id, encounter, person, visit, duration, age, gender, ethnicity, status, unit status
    data = [
        (1, 10, "a", 1, 2000, "65", "M", "x", "Alive", "Alive"),
        (2, 10, "a", 2, 1440, "> 89", "", "x", "Expired", "Expired"),
        (3, 11, "b", 1, 1439, "", "F", None, "Expired", "Expired"),
        (4, 12, "c", None, 5000, None, "F", "x", "Alive", "Alive"),
        (5, 13, "d", 1, None, "abc", "F", "x", "Alive", "Alive"),
        (6, 14, "e", 1, 9000, "70", "F", "x", "", "Alive"),
        (7, 15, "f", 1, 9000, "70", "F", "x", None, "Alive"),
        (8, 16, "g", 1, 9000, "70", "F", "x", "Transferred", "Alive"),
    ]
    return spark.createDataFrame(data, (
        "patientunitstayid long, patienthealthsystemstayid long, uniquepid string, unitvisitnumber int, "
        "unitdischargeoffset long, age string, gender string, ethnicity string, hospitaldischargestatus string, "
        "unitdischargestatus string")).withColumn("hospitaladmitoffset", F.lit(0))


def test_outcome_counts_null_and_blank(patients):
    report = cohort.outcome_report(patients, R.outcome).first()
    assert (report["initial_stays"], report["excluded_unknown"], report["retained"], report["expired"]) == (8, 3, 5, 2)
    spread = profile.outcome_distribution(patients, R.outcome).first()
    assert (spread["missing"], spread["other"], spread["known"]) == (2, 1, 5)


def test_age_rules(patients):
    got = {r[0]: (r[1], r[2]) for r in clean.harmonize_age(patients, "age").select(
        R.entity, "age_numeric", "age_gt89").collect()}
    assert got[1] == (65.0, 0) and got[2] == (90.0, 1) and got[3] == (None, None)
    assert got[4] == (None, None) and got[5] == (None, 0)


def test_kept_removed_unknown_add_up(patients):
    enc = clean.encode_outcome(patients, R.outcome)
    visit = cohort.index_report_by_visit(enc, R.visit, R.outcome.label).first()
    assert (visit["retained"], visit["removed"], visit["unknown"]) == (3, 1, 1)
    assert visit["retained"] + visit["removed"] + visit["unknown"] == visit["initial_stays"]
    order = cohort.index_report_by_order(enc, R.encounter, R.index_order, R.outcome.label).first()
    assert (order["retained"], order["removed"], order["removed_expired"]) == (4, 1, 1)
    short = cohort.landmark_report(cohort.index_by_visit(enc, R.visit), R, 1440).first()
    assert (short["short_stays"], short["eligible"], short["unknown"], short["short_unit_expired"]) == (1, 1, 1, 1)


def test_first_per_encounter_keeps_whole_rows(patients):
    first = cohort.index_by_order(patients, R.encounter, R.index_order)
    assert first.columns == patients.columns
    assert rows(first.select(R.entity), R.entity) == [(1,), (3,), (4,), (5,), (6,), (7,), (8,)]


def test_attrition_is_nested(patients):
    flow = cohort.attrition_flow(patients, R, 1440).orderBy("step_no").collect()
    assert [r["n"] for r in flow] == [8, 5, 3, 1, 1]
    assert [r["removed"] for r in flow] == [0, 3, 2, 2, 0]


def test_attrition_of_first_per_encounter_ends_in_its_cohort(patients):
    from cohortmill.plans import steps
    flow = cohort.attrition_flow(patients, R, 1440, first_per_encounter=True).orderBy("step_no").collect()
    assert flow[-1]["n"] == steps.select_cohort(patients, P, "first_per_encounter").count()


def test_window_edges(spark):
    df = spark.createDataFrame([(-1,), (0,), (1440,), (1441,), (None,)], "t long")
    flags = clean.time_flags(df, "t").orderBy("t").collect()
    assert [(r[1], r[2], r[3]) for r in flags] == [
        (None, None, None), (True, False, False), (False, True, False), (False, True, False), (False, False, True)]
    assert clean.in_window(df, "t").count() == 2
    with pytest.raises(ValueError):
        cohort.assert_inside(df, "t")
    assert cohort.assert_inside(clean.in_window(df, "t"), "t").count() == 2


def test_masks_are_inclusive_and_idempotent(spark):
    b = (Bound("v", 10.0, 20.0),)
    df = spark.createDataFrame([("9.99",), ("10",), ("20",), ("20.01",), ("-3",), ("x",), (None,)], "v string")
    once = clean.mask_wide(df, b)
    assert sorted(r[0] for r in once.collect() if r[0] is not None) == [10.0, 20.0]
    assert sorted(map(str, clean.mask_wide(once, b).collect())) == sorted(map(str, once.collect()))


def test_long_mask_passes_unbounded_names(spark):
    df = spark.createDataFrame([("a", 5.0), ("a", 11.0), ("free", -1e9), ("a", None), (None, 3.0)], "name string, v double")
    bounds = (Bound("a", 0.0, 10.0),)
    masked = clean.mask_long(df, "name", "v", bounds)
    got = sorted((str(r["name"]), str(r["v"]), str(r["labresult_num"])) for r in masked.collect())
    assert got == sorted([("a", "5.0", "5.0"), ("a", "11.0", "None"), ("free", "-1000000000.0", "-1000000000.0"),
                          ("a", "None", "None"), ("None", "3.0", "3.0")])
    assert clean.mask_long(df, "name", "v", ()).where("v is not null and labresult_num is null").count() == 0


def test_wide_summary_single_reading_has_no_std(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 1.0), (2, 3.0), (2, None)], "k long, v double")
    got = {r["k"]: r for r in measures.wide_features(df, "k", ("v",)).collect()}
    assert got[1]["v_std"] is None and got[1]["v_count"] == 1
    assert got[2]["v_std"] == pytest.approx(2 ** 0.5) and got[2]["v_count"] == 2
    assert got[2]["vital_measurement_count"] == 3


def test_long_first_last_ties_and_nulls(spark):
    data = [(1, "a", 0, 1, None), (1, "a", 5, 2, 7.0), (1, "a", 5, 3, 8.0), (1, "a", 9, 1, 4.0), (1, "a", 9, 2, None),
            (1, "other", 1, 1, 3.0), (2, "a", 1, 1, None)]
    df = spark.createDataFrame(data, "k long, name string, t long, id long, v double")
    got = {r["k"]: r for r in measures.long_features(df, "k", "name", "v", "t", "id", (("a", "a"), ("b", "b"))).collect()}
    one = got[1]
    assert (one["a_first"], one["a_last"], one["a_min"], one["a_max"], one["a_count"]) == (7.0, 4.0, 4.0, 8.0, 3)
    assert one["a_mean"] == pytest.approx(19 / 3) and one["lab_measurement_count"] == 6
    assert one["b_first"] is None and one["b_count"] is None
    assert got[2]["a_count"] is None and got[2]["lab_measurement_count"] == 1


def test_assembly_fills_counts_only(spark):
    f = P.features
    base = spark.createDataFrame([(1, 10, 0, 50.0)], "patientunitstayid long, patienthealthsystemstayid long, "
                                 "hospital_mortality int, age_numeric double")
    empty_v = spark.createDataFrame([], "patientunitstayid long, observationoffset long, " + ", ".join(f"{c} double" for c in f.wide))
    empty_l = spark.createDataFrame([], "patientunitstayid long, n string, v double, t long, id long")
    out = measures.assemble(base, measures.wide_features(empty_v, R.entity, f.wide),
                            measures.long_features(empty_l, R.entity, "n", "v", "t", "id", f.long), R.entity, f).first()
    assert out["heartrate_count"] == 0 and out["heartrate_mean"] is None and out["sodium_count"] == 0
    assert out["available_lab_count"] == 0 and out["missing_feature_count"] == 28 + 75


def test_repeated_rows_count_rows_not_groups(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 1), (2, 1), (None, 1), (None, 1)], "k long, t long")
    assert rows(profile.duplicate_rows(df, ["k", "t"]), "rows") == [(6, 5)]


def test_orphans_and_hot_keys(spark):
    child = spark.createDataFrame([(1,)] * 50 + [(2,), (9,), (9,), (None,)], "k long")
    parent = spark.createDataFrame([(1,), (2,), (2,), (3,)], "k long")
    r = profile.orphan_records(child, parent, "k", "c").first()
    assert (r["records"], r["entities"], r["orphan_records"], r["orphan_entities"]) == (54, 3, 3, 1)
    c = profile.key_coverage(child, parent, "k", "c").first()
    assert (c["parents"], c["covered"]) == (3, 2)


def test_identifier_validation_counts_orphans(spark, patients):
    lab = spark.createDataFrame([(1, "Hgb", 5), (1, "Hgb", 5), (1, "Hct", 5), (99, "Hgb", 5), (99, "Hgb", 6), (None, "Hgb", 7)],
                                "patientunitstayid long, labname string, labresultoffset long")
    vital = spark.createDataFrame([(1, 5), (77, 5), (77, 5)], "patientunitstayid long, observationoffset long")
    got = {r["table_name"]: r for r in profile.identifier_validation(P, patients, lab, vital).collect()}
    columns = ("rows", "null_keys", "orphan_rows", "repeated_rows")
    assert {t: tuple(r[c] for c in columns) for t, r in got.items()} == {
        "patient": (8, 0, 0, 0), "lab": (6, 1, 3, 2), "vital": (3, 0, 2, 2)}


def test_restriction_is_the_same_broadcast_or_not(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 10)
    ids = spark.range(3).withColumnRenamed("id", "k")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    small = rows(cohort.restrict_to(df, ids, "k"), "id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows(cohort.restrict_to(df, ids, "k"), "id") == small and len(small) == 30
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_schema_and_leakage_guards(spark, patients):
    t = {"patient": patients.drop("age")}
    required = {"patient": P.required["patient"]}
    assert profile.schema_check(t, required).first()["missing_columns"] == "age"
    with pytest.raises(ValueError):
        profile.schema_check(t, required, strict=True)
    assert profile.leaking_columns(["heartrate_mean", "UnitDischargeOffset", "hospitaldischargeyear"]) == [
        "UnitDischargeOffset", "hospitaldischargeyear"]


def test_model_table_guard(spark):
    groups = {"g": ["x"]}
    bad = spark.createDataFrame([(1, 0, 1.0), (1, 2, 1.0), (2, None, 1.0)], "k long, y int, x double")
    report = profile.model_table_report(bad, "k", "y", groups)
    assert report.first()["invalid_labels"] == 2 and not report.first()["one_row_per_entity"]
    with pytest.raises(ValueError):
        profile.require_model_table(report)
    good = spark.createDataFrame([(1, 0, 1.0), (2, 1, 1.0)], "k long, y int, x double")
    profile.require_model_table(profile.model_table_report(good, "k", "y", groups))


def test_histogram_keeps_empty_bins_and_closes_the_last(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (9.99,), (11.0,), (None,)], "v double")
    assert [r["n"] for r in profile.histogram(df, "v", 0.0, 10.0, 5).orderBy("bin").collect()] == [1, 0, 0, 0, 2]


def test_mode_ties_go_to_the_smallest(spark):
    df = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (4.0, None)], "x double, c string")
    got = {r["feature"]: r for r in profile.baseline_profile(df, ["x"], ["c"]).collect()}
    assert got["x"]["numeric_value"] == 2.0 and got["c"]["category_value"] == "a"


def test_folds_keep_groups_whole_and_balanced(spark):
    df = spark.range(4000).select((F.col("id") % 1500).alias("g"), (F.col("id") % 11 == 0).cast("int").alias("y"))
    folds = split.group_folds(df, "g", "y")
    assert folds.count() == 1500 == folds.select("g").distinct().count()
    per = folds.groupBy("stratum", "fold").count().groupBy("stratum").agg(F.max("count") - F.min("count")).collect()
    assert all(r[1] <= 1 for r in per)
    again = split.group_folds(df.repartition(7), "g", "y")
    assert rows(folds.select("g", "fold"), "g") == rows(again.select("g", "fold"), "g")
    placed = split.with_split(df, folds, "g")
    split.require_disjoint(placed, "g")
    with pytest.raises(ValueError):
        split.require_disjoint(placed.unionByName(placed.withColumn("split", F.lit("test"))), "g")


def test_distinct_entities_by_bitmap_and_sketch(spark):
    df = spark.range(60_000).select((F.col("id") % 7).alias("name"), F.when(F.col("id") % 5 > 0, (
        F.col("id") * F.col("id")) % 40_009 - 20_000).alias("key"), F.lit(None).cast("double").alias("v"))
    df = df.unionByName(spark.createDataFrame([(99, None, 1.0), (None, 5, None), (None, 5, 2.0), (3, -(2 ** 62), None)], df.schema))
    want = {r["name"]: r["entity_count"] for r in df.groupBy("name").agg(F.count_distinct("key").alias("entity_count")).collect()}
    exact = {r["name"]: r["entity_count"] for r in profile.top_names(df, "name", "key", "v", how="bitmap").collect()}
    assert exact == want and exact[99] == 0 and exact[None] == 1
    sketch = {r["name"]: r["entity_count"] for r in profile.top_names(df, "name", "key", "v", how="sketch").collect()}
    # Four standard errors of the stated size.
    assert all(abs(sketch[n] - c) <= 4 * 1.04 / 64 * c + 1 for n, c in want.items()) and sketch != want
    plain = profile.top_names(df, "name", "key", "v").collect()
    assert [tuple(r) for r in profile.top_names(df, "name", "key", "v", how="bitmap").collect()] == [tuple(r) for r in plain]
    with pytest.raises(ValueError):
        profile.distinct_entities(df, "name", "key", "guess")


def test_packed_folds_even_out_rows_and_positives(spark):
    """Groups of very different sizes, one of them huge: sums of two folds differ by at most the largest group."""
    rows = [(g, int(i < g % 4)) for g in range(400) for i in range(1 + (g * g) % 23)]
    rows += [(1000, int(i % 90 == 0)) for i in range(1200)] + [(2000 + i, 0) for i in range(900)] + [(None, 1)] * 5
    df = spark.createDataFrame(rows, "g long, y int")
    folds = split.packed_folds(df, "g", "y")
    held = {r["g"]: r for r in folds.collect()}
    plain = {}
    for g, y in rows:
        if g is not None:
            n, p = plain.get(g, (0, 0))
            plain[g] = (n + 1, p + y)
    assert {g: (r["rows"], r["positives"]) for g, r in held.items()} == plain
    sums = [[sum(v) for v in zip(*[plain[g] for g, r in held.items() if r["fold"] == f])] for f in range(5)]
    assert max(s[1] for s in sums) - min(s[1] for s in sums) <= max(p for _, p in plain.values())
    assert max(s[0] for s in sums) - min(s[0] for s in sums) <= max(n for n, _ in plain.values())
    # The other folds share what the huge group leaves them.
    others = sorted(s[0] for s in sums)[:4]
    assert others[-1] - others[0] <= 23
    again = split.packed_folds(df.repartition(7), "g", "y")
    assert {r["g"]: r["fold"] for r in again.collect()} == {g: r["fold"] for g, r in held.items()}
    other = {r["g"]: r["fold"] for r in split.packed_folds(df, "g", "y", seed=1).collect()}
    assert other != {g: r["fold"] for g, r in held.items()}
    assert split.packed_folds(df.where("g < 0"), "g", "y").collect() == []


def test_dealing_in_bulk_equals_dealing_one_by_one():
    for load in ([0, 0, 0], [50, 3, 9], [7, 7, 100], [0]):
        for item, n in ((1, 1000), (4, 17), (9, 2), (3, 0)):
            slow = list(load)
            for _ in range(n):
                f = min(range(len(slow)), key=lambda i: (slow[i], i))
                slow[f] += item
            fast = list(load)
            dealt = split.deal(fast, [0] * len(load), item, n)
            assert sum(dealt) == n and [a + item * k for a, k in zip(load, dealt)] == fast
            assert sorted(fast) == sorted(slow) or max(fast) - min(fast) <= max(item, max(slow) - min(slow))


def test_row_numbers_of_a_key_that_holds_most_rows(spark):
    from cohortmill.operators import running
    df = spark.range(3000).select(F.when(F.col("id") % 10 < 8, 0).when(F.col("id") % 10 == 8, None).otherwise(F.col("id") % 7).alias("k"),
                                  F.md5(F.col("id").cast("string")).alias("o"))
    got, want = running.row_numbers(df, ["k"], ["o"]).collect(), {}
    for r in got:
        want.setdefault(r["k"], []).append((r["o"], r["rn"]))
    assert len(got) == 3000 and all([n for _, n in sorted(v)] == list(range(1, len(v) + 1)) for v in want.values())


def test_encoder_constants_unseen_levels_and_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.0, 5.0, "a"), (2, None, 5.0, "b"), (3, 3.0, 5.0, None), (4, 8.0, 5.0, "a")],
                               "k long, x double, flat double, c string")
    enc = split.fit_encoder(df, ["x", "flat"], ["c"])
    assert enc.medians["x"] == 3.0 and enc.stds["flat"] == 1.0 and enc.levels["c"] == ["Unknown", "a", "b"]
    new = spark.createDataFrame([(9, None, 6.0, "zzz")], df.schema)
    got = enc.encode(new, ["k"]).first()["features"].toArray().tolist()
    assert got[1] == 1.0 and got[2:] == [0.0, 0.0, 0.0]
    enc.save(spark, str(tmp_path / "enc"))
    assert split.Encoder.load(spark, str(tmp_path / "enc")) == enc


def test_many_levels(spark):
    df = spark.range(40_000).select("id", F.concat(F.lit("v"), F.col("id") % 20_000).alias("c"), F.lit(1.0).alias("x"))
    enc = split.fit_encoder(df, ["x"], ["c"])
    assert len(enc.names) == 20_001
    row = enc.encode(df.where("id = 20007"), ["id"]).first()["features"]
    assert row.size == 20_001 and row[enc.names.index("c_v7")] == 1.0 and row.numNonzeros() == 1


def test_rows_without_a_group_are_kept(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 10 > 0, F.col("id") % 90).alias("g"), (F.col("id") % 7 == 0).cast("int").alias("y"))
    placed = split.with_split(df, split.group_folds(df, "g", "y"), "g", "id")
    assert placed.count() == 1000 and placed.where("split is null").count() == 0
    split.require_disjoint(placed, "g")
    alone = {r["split"]: r["count"] for r in placed.where("g is null").groupBy("split").count().collect()}
    assert alone["train"] > alone["test"] > 0 and alone["validation"] > 0
    assert split.split_summary(placed, "g", "y").agg(F.sum("persons"), F.sum("stays")).first()[:] == (81 + 100, 1000)
