"""Cleaning, cohort and feature queries."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import functions as F

from checks.registry import (
    ADMISSION, COUNTS, FEATURES, GROUPS, P, R, VALUES, as_double, d, n, pct, query, tables,
)
from checks.views import view
from cohortmill import presets
from cohortmill.operators import clean, cohort, measures, profile, split
from cohortmill.plans import steps
from cohortmill.session import checkpoint_dir, written

KEY = R.entity


def encoded(spark, sf):
    return clean.encode_outcome(view(spark, sf, "fx_patient"), R.outcome)


@query("encode_target", "select patientunitstayid, hospitaldischargestatus, cast(hospital_mortality as bigint) hospital_mortality from enc")
def _(spark, sf):
    return encoded(spark, sf).select(KEY, R.outcome.column, R.outcome.label)


@query("target_attrition", f"""
select count(*) initial_stays, count(*) - count(*) filter (where k) excluded_unknown,
  {d(pct("(count(*) - count(*) filter (where k))", "count(*)"), "excluded_pct")},
  count(*) filter (where k) retained, count(*) filter (where s = 'Alive') alive, count(*) filter (where s = 'Expired') expired,
  {d(pct("count(*) filter (where s = 'Expired')", "count(*) filter (where k)"), "prevalence_pct")}
from (select hospitaldischargestatus s, coalesce(hospitaldischargestatus in ('Alive', 'Expired'), false) k from fx_patient)""")
def _(spark, sf):
    return cohort.outcome_report(view(spark, sf, "fx_patient"), R.outcome)


@query("harmonize_age", f"""
select patientunitstayid, age,
  {d("case when age = '> 89' then 1 when age is null or age = '' then null else 0 end", "age_gt89")},
  {d("case when age = '> 89' then 90 when age is null or age = '' then null else try_cast(age as double) end", "age_numeric")}
from fx_patient""")
def _(spark, sf):
    aged = clean.harmonize_age(view(spark, sf, "fx_patient"), "age").select(KEY, "age", "age_gt89", "age_numeric")
    return as_double(aged, "age_gt89")


@query("lenient_cast", f"select patientunitstayid, {d('try_cast(age as double)', 'age_num')}, {d('try_cast(ethnicity as double)', 'ethnicity_num')} from fx_patient")
def _(spark, sf):
    return clean.lenient_columns(view(spark, sf, "fx_patient"), ["age", "ethnicity"]).select(KEY, "age_num", "ethnicity_num")


@query("temporal_flags", """
select patientunitstayid, labid, labresultoffset, labresultoffset < 0 pre_icu,
  labresultoffset >= 0 and labresultoffset <= 1440 first_24h, labresultoffset > 1440 post_24h from fx_lab""")
def _(spark, sf):
    return clean.time_flags(view(spark, sf, "fx_lab"), R.long_offset).select(
        KEY, "labid", R.long_offset, "pre_icu", "first_24h", "post_24h")


@query("mask_wide", "select patientunitstayid, observationoffset, " + ", ".join(d(c) for c in FEATURES.wide) + " from vmask")
def _(spark, sf):
    return clean.mask_wide(view(spark, sf, "fx_vital"), P.wide_bounds)


@query("mask_long", f"select patientunitstayid, labid, labname, {d('labresult_num')} from lmask")
def _(spark, sf):
    return clean.mask_long(view(spark, sf, "fx_lab"), R.long_name, R.long_value, P.long_bounds).select(
        KEY, "labid", R.long_name, "labresult_num")


@query("index_stay_visit", "select patientunitstayid, unitvisitnumber::bigint unitvisitnumber, hospital_mortality::bigint hospital_mortality from enc where unitvisitnumber = 1")
def _(spark, sf):
    return cohort.index_by_visit(encoded(spark, sf), R.visit).select(KEY, R.visit, R.outcome.label)


ORDER = R.index_order


@query("index_stay_first", """
select patientunitstayid, patienthealthsystemstayid, unitvisitnumber::bigint unitvisitnumber from (
  select *, row_number() over (partition by patienthealthsystemstayid order by unitvisitnumber, hospitaladmitoffset, patientunitstayid) rn from enc)
where rn = 1""")
def _(spark, sf):
    return cohort.index_by_order(encoded(spark, sf), R.encounter, ORDER).select(KEY, R.encounter, R.visit)


def index_sql(name, kept, removed):
    return f"""
select '{name}' strategy, count(*) initial_stays, count(*) filter (where {removed}) removed,
  {d(pct(f"count(*) filter (where {removed})", "count(*)"), "removed_pct")},
  count(*) filter (where {kept}) retained,
  count(*) - count(*) filter (where {kept}) - count(*) filter (where {removed}) "unknown",
  count(*) filter (where {kept} and hospital_mortality = 1) retained_expired,
  {d(pct(f"count(*) filter (where {kept} and hospital_mortality = 1)", f"count(*) filter (where {kept})"), "retained_mortality_pct")},
  count(*) filter (where {removed} and hospital_mortality = 1) removed_expired,
  {d(pct(f"count(*) filter (where {removed} and hospital_mortality = 1)", f"count(*) filter (where {removed})"), "removed_mortality_pct")}
from (select *, row_number() over (partition by patienthealthsystemstayid order by unitvisitnumber, hospitaladmitoffset, patientunitstayid) rn from enc)"""


@query("index_stay_report", index_sql("visit_number", "unitvisitnumber = 1", "unitvisitnumber > 1") + " union all "
       + index_sql("first_per_encounter", "rn = 1", "rn > 1"))
def _(spark, sf):
    enc = encoded(spark, sf)
    return cohort.index_report_by_visit(enc, R.visit, R.outcome.label).unionByName(
        cohort.index_report_by_order(enc, R.encounter, ORDER, R.outcome.label))


@query("landmark_filter", "select patientunitstayid, unitdischargeoffset, hospital_mortality::bigint hospital_mortality from enc where unitdischargeoffset >= 1440")
def _(spark, sf):
    return cohort.landmark(encoded(spark, sf), R.duration, P.landmark).select(KEY, R.duration, R.outcome.label)


SHORT, LONG = "count(*) filter (where s)", "count(*) filter (where l)"


@query("landmark_report", f"""
select 1440::bigint landmark_minutes, count(*) initial_stays, {SHORT} short_stays, {d(pct(SHORT, "count(*)"), "short_pct")},
  count(*) filter (where s and y = 1) short_expired, count(*) filter (where s and y = 0) short_alive,
  {d(pct("count(*) filter (where s and y = 1)", SHORT), "short_mortality_pct")},
  count(*) filter (where s and unitdischargestatus = 'Expired') short_unit_expired,
  {LONG} eligible, {d(pct(LONG, "count(*)"), "eligible_pct")}, count(*) - {SHORT} - {LONG} "unknown",
  count(*) filter (where l and y = 1) eligible_expired, count(*) filter (where l and y = 0) eligible_alive,
  {d(pct("count(*) filter (where l and y = 1)", LONG), "eligible_mortality_pct")}
from (select *, hospital_mortality y, unitdischargeoffset < 1440 s, unitdischargeoffset >= 1440 l from enc where unitvisitnumber = 1)""")
def _(spark, sf):
    return cohort.landmark_report(cohort.index_by_visit(encoded(spark, sf), R.visit), R, P.landmark)


def flow_step(strategy, source, i, name, where, before):
    return f"""
select '{strategy}' strategy, {i}::bigint step_no, '{name}' step, count(*) filter (where {where}) n,
  count(*) filter (where {where} and hospitaldischargestatus = 'Expired') positives,
  count(*) filter (where {where} and hospitaldischargestatus = 'Alive') negatives,
  count(*) filter (where {before}) - count(*) filter (where {where}) removed,
  {d(pct(f"count(*) filter (where {where} and hospitaldischargestatus = 'Expired')",
         f"count(*) filter (where {where} and hospitaldischargestatus in ('Expired', 'Alive'))"), "prevalence_pct")}
from {source}"""


KNOWN = "hospitaldischargestatus in ('Alive', 'Expired')"
NUMBERED = f"""(select *, row_number() over (partition by patienthealthsystemstayid, {KNOWN}
  order by unitvisitnumber, hospitaladmitoffset, patientunitstayid) rn from fx_patient)"""


def flow(strategy, source, rule):
    index = f"{KNOWN} and {rule}"
    land = f"{index} and unitdischargeoffset >= 1440"
    return " union all ".join(flow_step(strategy, source, *s) for s in (
        (0, "raw", "true", "true"), (1, "known_outcome", KNOWN, "true"), (2, "index_stay", index, KNOWN),
        (3, "landmark", land, index), (4, "final_cohort", land, land)))


@query("attrition_flow", flow("visit_number", "fx_patient", "unitvisitnumber = 1") + " union all "
       + flow("first_per_encounter", NUMBERED, "rn = 1"))
def _(spark, sf):
    patient = view(spark, sf, "fx_patient")
    both = [cohort.attrition_flow(patient, R, P.landmark, first).withColumn("strategy", F.lit(name))
            for name, first in (("visit_number", False), ("first_per_encounter", True))]
    return both[0].unionByName(both[1])


@query("window_extract", """
select patientunitstayid, labid, labresultoffset from fx_lab semi join cohort using (patientunitstayid)
where labresultoffset between 0 and 1440""")
def _(spark, sf):
    t = tables(spark, sf)
    ids = steps.select_cohort(t.patient, P)
    return cohort.extract_window(t.lab, ids, KEY, R.long_offset).select(KEY, "labid", R.long_offset)


def coverage_sql(name, source, offset):
    return f"""
select '{name}' table_name, count(*) records, count(distinct patientunitstayid) entities,
  {d("100.0 * count(distinct patientunitstayid) / (select count(*) from cohort)", "coverage_pct")}
from {source} semi join cohort using (patientunitstayid) where {offset} between 0 and 1440"""


@query("measurement_coverage", coverage_sql("lab", "fx_lab", "labresultoffset") + " union all "
       + coverage_sql("vital", "fx_vital", "observationoffset"))
def _(spark, sf):
    return steps.build_cohort(tables(spark, sf), P)["coverage"]


def audit_bounds(table, bounds):
    return ", ".join(f"('{table}', '{b.name}', {b.low}::double, {b.high}::double)" for b in bounds)


@query("cohort_invariants", """
select 'labs' table_name, count(*) "rows", 0 before, 0 after from fx_lab
where labresultoffset between 0 and 1440 and patientunitstayid in (select patientunitstayid from cohort)
union all
select 'vitals', count(*), 0, 0 from fx_vital
where observationoffset between 0 and 1440 and patientunitstayid in (select patientunitstayid from cohort)""")
def _(spark, sf):
    path = posixpath.join(checkpoint_dir(spark), f"cohort-{uuid.uuid4().hex}")
    return steps.write_cohort(tables(spark, sf), P, path)["invariants"]


@query("cleaning_audit", f"""
with m as (
  select 'lab' table_name, labname "name", labresult v from fx_lab semi join cohort using (patientunitstayid)
  where labresultoffset between 0 and 1440
  union all
  select 'vital', "name", v from (
    unpivot (select {", ".join(f"cast({b.name} as double) {b.name}" for b in P.wide_bounds)} from fx_vital
             semi join cohort using (patientunitstayid) where observationoffset between 0 and 1440)
    on {", ".join(b.name for b in P.wide_bounds)} into name "name" value v)),
b(table_name, "name", low, high) as (values {audit_bounds("lab", P.long_bounds)}, {audit_bounds("vital", P.wide_bounds)}),
c as (
  select b.table_name, b."name", low, high, count(v) total_non_null, count(*) filter (where v < low or v > high) nullified,
    count(*) filter (where v < 0) negative_nullified
  from b left join m using (table_name, "name") group by all)
select table_name, "name", {d("low")}, {d("high")}, cast(null as varchar) source, total_non_null, nullified,
  {d(pct("nullified", "total_non_null"), "nullified_pct")}, negative_nullified
from c where table_name = 'vital' or total_non_null > 0""")
def _(spark, sf):
    return steps.build_cohort(tables(spark, sf), P)["cleaning_audit"]


@query("vital_features", "select patientunitstayid, " + ", ".join(
    [d(c) for c in GROUPS["vital_clinical_features"]] + [n(c) for c in GROUPS["vital_quality_features"]]) + " from vfeat")
def _(spark, sf):
    vitals = clean.mask_wide(clean.in_window(view(spark, sf, "fx_vital"), R.wide_offset), P.wide_bounds)
    return measures.wide_features(vitals, KEY, FEATURES.wide)


def masked_labs(spark, sf):
    labs = clean.in_window(view(spark, sf, "fx_lab"), R.long_offset)
    return clean.mask_long(labs, R.long_name, R.long_value, P.long_bounds)


def lab_features(spark, sf):
    return measures.long_features(masked_labs(spark, sf), KEY, R.long_name, "labresult_num", R.long_offset,
                                  R.long_order, FEATURES.long)


LAB_COUNTS = GROUPS["lab_quality_features"][1:]


@query("lab_features", "select patientunitstayid, " + ", ".join(
    [d(c) for c in GROUPS["lab_clinical_features"]] + [n("lab_measurement_count")]
    + [d(c) for c in LAB_COUNTS]) + " from lfeat")
def _(spark, sf):
    return as_double(lab_features(spark, sf), *LAB_COUNTS)


@query("full_join_coalesce", f"""
select patientunitstayid, {d("vital_measurement_count")}, {d("lab_measurement_count")}, {d("heartrate_mean")}, {d("sodium_mean")}
from vfeat full join lfeat using (patientunitstayid)""")
def _(spark, sf):
    vitals = clean.mask_wide(clean.in_window(view(spark, sf, "fx_vital"), R.wide_offset), P.wide_bounds)
    wide = measures.wide_features(vitals, KEY, ("heartrate",)).select(KEY, "vital_measurement_count", "heartrate_mean")
    long = measures.long_features(masked_labs(spark, sf), KEY, R.long_name, "labresult_num", R.long_offset, R.long_order,
                                  (("sodium", "sodium"),)).select(KEY, "lab_measurement_count", "sodium_mean")
    return as_double(measures.full_join_summaries([wide, long], KEY), "vital_measurement_count", "lab_measurement_count")


ADMISSION_SQL = ", ".join(["patientunitstayid", "patienthealthsystemstayid", n("hospital_mortality"), d("age_numeric"),
                           d("age_gt89"), "gender", "ethnicity", d("admissionheight"), d("admissionweight"), "unittype",
                           "unitadmitsource"])


@query("admission_features", f"select {ADMISSION_SQL} from admission")
def _(spark, sf):
    return as_double(measures.admission_features(steps.select_cohort(view(spark, sf, "fx_patient"), P), FEATURES), "age_gt89")


def feature_table(spark, sf):
    return steps.build_features(tables(spark, sf), P)


@query("feature_table", f"select {ADMISSION_SQL}, " + ", ".join(
    [d(c) for c in VALUES] + [n(c) for c in COUNTS + GROUPS["meta_quality_features"]]) + " from ftable")
def _(spark, sf):
    return as_double(feature_table(spark, sf), "age_gt89")


ALL = [(g, c, i) for g, cols in GROUPS.items() for i, c in enumerate(cols)]


@query("feature_manifest", "with counted as (select " + ", ".join(f"count({c}) {c}" for _, c, _ in ALL) + " from ftable) "
       + " union all ".join(f"select '{g}' feature_group, '{c}' feature, {i}::bigint \"position\", {c} filled_rows from counted"
                            for g, c, i in ALL))
def _(spark, sf):
    return profile.feature_manifest(feature_table(spark, sf), GROUPS)


@query("model_table_validation", f"""
select count(*) total_rows, count(distinct patientunitstayid) unique_entities,
  count(*) = count(distinct patientunitstayid) one_row_per_entity,
  count(*) filter (where hospital_mortality = 0) alive, count(*) filter (where hospital_mortality = 1) expired,
  {d(pct("count(*) filter (where hospital_mortality = 1)", "count(*)"), "prevalence_pct")},
  count(*) filter (where hospital_mortality is null or hospital_mortality not in (0, 1)) invalid_labels,
  0::bigint leaking_columns, 138::bigint total_features from ftable""")
def _(spark, sf):
    return profile.model_table_report(feature_table(spark, sf), KEY, FEATURES.target, GROUPS)


@query("missingness_by_group", """
with m as (""" + " union all ".join(
    f"select '{c}' c, '{'demographics' if c in ADMISSION else 'vitals' if c in GROUPS['vital_clinical_features'] else 'special_labs' if c.rsplit('_', 1)[0] in presets.SPECIAL_LABS else 'routine_labs'}' category, "
    f"100.0 * count(*) filter (where {c if c not in ('gender', 'ethnicity', 'unittype', 'unitadmitsource') else f'''nullif({c}, '')'''} is null) / count(*) pct from ftable"
    for c in ADMISSION + VALUES) + f""")
select category, count(*) features, {d("avg(pct)", "mean_missing_pct")} from m group by category""")
def _(spark, sf):
    labs = GROUPS["lab_clinical_features"]
    special = [c for c in labs if c.rsplit("_", 1)[0] in presets.SPECIAL_LABS]
    groups = {"demographics": ADMISSION, "vitals": GROUPS["vital_clinical_features"],
              "special_labs": special, "routine_labs": [c for c in labs if c not in special]}
    missing = profile.missingness(feature_table(spark, sf), ADMISSION + VALUES, "features")
    return profile.missingness_by_group(missing, groups)


@query("missingness_bands", "with m as (" + " union all ".join(
    f"select '{c}' column_name, count(*) filter (where {c} is null) null_count, count(*) total from ftable" for c in VALUES)
       + f""")
select column_name, null_count, {d("100.0 * null_count / total", "missing_pct")},
  case when 100.0 * null_count / total > 50 then 'high' when 100.0 * null_count / total > 20 then 'review' else 'acceptable' end band
from m where null_count > 0 order by 100.0 * null_count / total desc, column_name limit 25""")
def _(spark, sf):
    return profile.missingness_bands(profile.missingness(feature_table(spark, sf), VALUES, "features"))


@query("missingness_totals", "with m as (" + " union all ".join(
    f"select 100.0 * count(*) filter (where {c} is null) / count(*) pct from ftable" for c in VALUES) + """)
select count(*) features, count(*) filter (where pct > 0) any_missing, count(*) filter (where pct > 20) over_20_pct,
  count(*) filter (where pct > 50) over_50_pct from m""")
def _(spark, sf):
    return profile.missingness_totals(profile.missingness(feature_table(spark, sf), VALUES, "features"))


@query("kpi_summary", f"""
select count(*) entities, {d(pct("count(*) filter (where missing_feature_count > 0)", "count(*)"), "any_missing_pct")},
  {d("avg(missing_feature_count)", "mean_missing")},
  {d(pct("count(*) filter (where available_lab_count >= 10)", "count(*)"), "lab_breadth_pct")},
  {d(pct("count(*) filter (where available_vital_count >= 6)", "count(*)"), "vital_breadth_pct")},
  {d("50.0 * avg(available_lab_count) / 15 + 50.0 * avg(available_vital_count) / 7", "completeness_pct")}
from ftable""")
def _(spark, sf):
    return profile.kpi_summary(feature_table(spark, sf), len(FEATURES.long), len(FEATURES.wide))


@query("rate_by_category", f"""
select unittype, {d("avg(hospital_mortality)", "rate")}, count(*) n from cohort where unittype is not null
group by unittype having count(*) >= 10 order by avg(hospital_mortality), unittype limit 6""")
def _(spark, sf):
    base = measures.admission_features(steps.select_cohort(view(spark, sf, "fx_patient"), P), FEATURES)
    return profile.rate_by_category(base, "unittype", FEATURES.target)


NUMERIC_BASE = ["age_numeric", "admissionweight", "heartrate_mean", "heartrate_min", "sao2_std", "sodium_mean",
                "available_lab_count", "missing_feature_count"]
CATEGORY_BASE = ["gender", "ethnicity", "unittype", "unitadmitsource"]


@query("baseline_profile", " union all ".join(
    [f"select '{c}' feature, {d(f'quantile_cont({c}::double, 0.5)', 'numeric_value')}, null::varchar category_value from ftable"
     for c in NUMERIC_BASE]
    + [f"(select '{c}' feature, null::double numeric_value, {c} category_value from ftable where {c} is not null "
       f"group by {c} order by count(*) desc, {c} limit 1)" for c in CATEGORY_BASE]))
def _(spark, sf):
    return profile.baseline_profile(written(feature_table(spark, sf)), NUMERIC_BASE, CATEGORY_BASE)


FOLDS_STEP = """
with g as (select uniquepid, count(*) "rows", count(*) filter (where hospital_mortality = 1) positives from cohort group by uniquepid),
s as (select *, (positives > 0)::int * 10 + least("rows", 3) stratum, md5('42:' || uniquepid::varchar) h from g),
folds as (select uniquepid, "rows", positives, stratum,
  (row_number() over (partition by stratum order by h, uniquepid) - 1) % 5 fold from s)
"""


def folded(spark, sf):
    base = steps.select_cohort(view(spark, sf, "fx_patient"), P)
    return base, split.group_folds(base, R.person, R.outcome.label)


@query("group_folds", FOLDS_STEP + """select uniquepid, "rows"::bigint "rows", positives, stratum::bigint stratum, fold::bigint fold from folds""")
def _(spark, sf):
    return folded(spark, sf)[1]


SPLIT = "case fold when 0 then 'test' when 1 then 'validation' else 'train' end"


@query("split_summary", FOLDS_STEP + f"""
select {SPLIT} split, count(*) stays, count(distinct uniquepid) persons, count(*) filter (where hospital_mortality = 1) positives,
  {d("avg(hospital_mortality)", "positive_rate")} from cohort join folds using (uniquepid) group by 1""")
def _(spark, sf):
    base, folds = folded(spark, sf)
    return split.split_summary(split.with_split(base, folds, R.person), R.person, R.outcome.label)


@query("split_overlap", FOLDS_STEP + f""",
x as (select distinct {SPLIT} split, uniquepid from cohort join folds using (uniquepid))
select pair, (select count(*) from (select uniquepid from x where split = a intersect select uniquepid from x where split = b)) shared_persons
from (values ('train-validation', 'train', 'validation'), ('train-test', 'train', 'test'), ('validation-test', 'validation', 'test')) t(pair, a, b)""")
def _(spark, sf):
    base, folds = folded(spark, sf)
    return split.split_overlap(split.with_split(base, folds, R.person), R.person)


@query("split_without_person", """
select case when uniquepid % 9 = 0 then null else uniquepid end is null no_person, count(*) stays
from cohort group by 1""")
def _(spark, sf):
    """Rows in = rows out, also for rows whose person is unknown."""
    base, _ = folded(spark, sf)
    holed = base.withColumn(R.person, F.when(F.col(R.person) % 9 != 0, F.col(R.person)))
    placed = split.with_split(holed, split.group_folds(holed, R.person, R.outcome.label), R.person, KEY)
    return placed.where("split in ('train', 'validation', 'test')").groupBy(
        F.col(R.person).isNull().alias("no_person")).agg(F.count(F.lit(1)).alias("stays"))


@query("test_metadata", FOLDS_STEP + """
select patientunitstayid, uniquepid, unittype from cohort join folds using (uniquepid) where fold = 0""")
def _(spark, sf):
    base, folds = folded(spark, sf)
    return split.with_split(base, folds, R.person).where("split = 'test'").select(KEY, R.person, "unittype")


@query("group_lookup", f"""
select patientunitstayid, {n("vital_measurement_count")}, {d("uniquepid")} from vfeat left join enc using (patientunitstayid)""")
def _(spark, sf):
    vitals = clean.in_window(view(spark, sf, "fx_vital"), R.wide_offset)
    counts = measures.wide_features(vitals, KEY, ())
    return as_double(split.lookup_group(counts, encoded(spark, sf), KEY, R.person), R.person)


ENCODE_NUM = ["age_numeric", "admissionheight", "admissionweight"]


@query("impute_median", "select feature, n, " + d("q", "median") + " from (" + " union all ".join(
    f"select '{c}' feature, count({c}) n, quantile_cont({c}, 0.5) q from ftable" for c in VALUES + ENCODE_NUM) + ") where n > 0")
def _(spark, sf):
    from cohortmill.operators.running import exact_medians
    return exact_medians(written(feature_table(spark, sf)), VALUES + ENCODE_NUM).withColumnRenamed("q0", "median")


SCALED = ["age_numeric", "admissionheight", "admissionweight"]


@query("standardize", "with med as (select " + ", ".join(f"quantile_cont({c}, 0.5) m_{c}" for c in SCALED) + " from cohort), "
       + "imp as (select patientunitstayid, " + ", ".join(f"coalesce({c}, m_{c}) {c}" for c in SCALED) + " from cohort, med), "
       + "mom as (select " + ", ".join(f"avg({c}) a_{c}, stddev_pop({c}) s_{c}" for c in SCALED) + " from imp) "
       + "select patientunitstayid, " + ", ".join(d(f"({c} - a_{c}) / s_{c}", c) for c in SCALED) + " from imp, mom")
def _(spark, sf):
    base = steps.select_cohort(view(spark, sf, "fx_patient"), P)
    encoder = split.fit_encoder(base, SCALED, [])
    return base.select(KEY, *encoder.columns())


GENDERS, UNITS = ["Female", "Male", "Unknown"], ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("one_hot", "select patientunitstayid, " + ", ".join(
    [f"(gender = '{g}')::int::double \"gender_{g}\"" for g in GENDERS]
    + [f"(unittype = '{u}')::int::double \"unittype_{u}\"" for u in UNITS]) + " from admission")
def _(spark, sf):
    base = measures.admission_features(steps.select_cohort(view(spark, sf, "fx_patient"), P), FEATURES)
    encoder = split.fit_encoder(base, [], ["gender", "unittype"])
    return base.select(KEY, *encoder.columns())


@query("class_weights", f"""
select count(*) n, count(*) filter (where hospital_mortality = 1) n_pos, count(*) filter (where hospital_mortality = 0) n_neg,
  {d("count(*) / (2.0 * count(*) filter (where hospital_mortality = 1))", "weight_pos")},
  {d("count(*) / (2.0 * count(*) filter (where hospital_mortality = 0))", "weight_neg")},
  {d("count(*) filter (where hospital_mortality = 0)::double / count(*) filter (where hospital_mortality = 1)", "scale_pos_weight")}
from cohort""")
def _(spark, sf):
    return split.class_weights(steps.select_cohort(view(spark, sf, "fx_patient"), P), R.outcome.label)
