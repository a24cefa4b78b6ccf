"""Validation and profiling queries over the raw tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import FEATURES, P, R, d, n, pct, query, tables
from checks.views import view
from cohortmill import presets
from cohortmill.operators import attribution, clean, measures, profile
from cohortmill.plans import steps

KEY = R.entity
WIDTH = {"patient": ("fx_patient", 15), "lab": ("fx_lab", 5), "vitalPeriodic": ("fx_vital", 9)}


@query("schema_check", " union all ".join(
    f"select '{t}' table_name, count(*) \"rows\", {w}::bigint total_columns, {len(P.required[t])}::bigint required_columns, "
    f"'' missing_columns, 'PASS' status from {v}" for t, (v, w) in WIDTH.items()))
def _(spark, sf):
    t = tables(spark, sf)
    return profile.schema_check({"patient": t.patient, "lab": t.lab, "vitalPeriodic": t.vital}, P.required)


PATIENT_COLUMNS = {"hospitaldischargestatus", "unitdischargestatus", "unitdischargeoffset", KEY, R.encounter, R.person}
TEXT = {"hospitaldischargestatus", "unitdischargestatus"}
IDS = (KEY, R.encounter, R.person)


def audit_row(column, category):
    present = column in PATIENT_COLUMNS
    filled = f"count(nullif({column}, ''))" if column in TEXT else f"count({column})" if present else "count(null)"
    leaking = any(p in column for p in presets.LEAKAGE_PARTS)
    return (f"select '{column}' column_name, '{category}' category, {str(present).lower()} present, "
            f"{str(leaking).lower()} name_is_leaking, {filled} filled_rows from fx_patient")


@query("leakage_audit", " union all ".join(
    [audit_row(c, k) for c, k in presets.LEAKAGE_COLUMNS] + [audit_row(c, "Surrogate Identifier") for c in IDS]))
def _(spark, sf):
    return profile.leakage_audit(view(spark, sf, "fx_patient"), presets.LEAKAGE_COLUMNS, IDS)


def orphan_sql(name, child):
    return f"""
select '{name}' table_name, count(*) records, count(distinct c.patientunitstayid) entities,
  count(*) filter (where e.patientunitstayid is null) orphan_records,
  count(distinct c.patientunitstayid) filter (where e.patientunitstayid is null) orphan_entities
from {child} c left join enc e on c.patientunitstayid = e.patientunitstayid"""


@query("orphan_records", orphan_sql("lab", "fx_lab") + " union all " + orphan_sql("vital", "fx_vital"))
def _(spark, sf):
    t = tables(spark, sf)
    known = clean.encode_outcome(t.patient, R.outcome)
    return profile.orphan_records(t.lab, known, KEY, "lab").unionByName(profile.orphan_records(t.vital, known, KEY, "vital"))


def covered_sql(name, child):
    return f"""
select '{name}' table_name, (select count(*) from fx_patient) parents, count(*) covered,
  {d("100.0 * count(*) / (select count(*) from fx_patient)", "coverage_pct")}
from fx_patient semi join {child} using (patientunitstayid)"""


@query("key_coverage", covered_sql("lab", "fx_lab") + " union all " + covered_sql("vital", "fx_vital"))
def _(spark, sf):
    t = tables(spark, sf)
    return profile.key_coverage(t.lab, t.patient, KEY, "lab").unionByName(profile.key_coverage(t.vital, t.patient, KEY, "vital"))


def identity_sql(name, source, keys):
    orphans = "0" if name == "patient" else (
        f"(select count(*) from {source} c anti join fx_patient e on c.patientunitstayid = e.patientunitstayid)")
    return f"""
select '{name}' table_name, sum(k)::bigint "rows", coalesce(sum(k) filter (where patientunitstayid is null), 0)::bigint null_keys,
  {orphans}::bigint orphan_rows, coalesce(sum(k) filter (where k > 1), 0)::bigint repeated_rows,
  {d("100.0 * coalesce(sum(k) filter (where k > 1), 0) / sum(k)", "repeated_pct")}
from (select {keys}, count(*) k from {source} group by {keys})"""


@query("identifier_validation", " union all ".join([
    identity_sql("patient", "fx_patient", "patientunitstayid"),
    identity_sql("lab", "fx_lab", "patientunitstayid, labname, labresultoffset"),
    identity_sql("vital", "fx_vital", "patientunitstayid, observationoffset")]))
def _(spark, sf):
    t = tables(spark, sf)
    return profile.identifier_validation(P, t.patient, t.lab, t.vital)


LEVELS = [KEY, R.encounter, R.person]


@query("identifier_hierarchy", " union all ".join(f"""
select '{c}' identifier, sum(k)::bigint total_rows, count(*) unique_count, coalesce(sum(k) filter (where k > 1), 0)::bigint duplicate_rows,
  {d("sum(k)::double / count(*)", "mean_rows")} from (select {c}, count(*) k from fx_patient group by {c})""" for c in LEVELS))
def _(spark, sf):
    return profile.identifier_hierarchy(view(spark, sf, "fx_patient"), LEVELS)


@query("repeat_entities", """
select count(*) persons, count(*) filter (where k > 1) repeat_persons, max(k) max_stays
from (select uniquepid, count(*) k from cohort group by uniquepid)""")
def _(spark, sf):
    return profile.repeat_entities(steps.select_cohort(view(spark, sf, "fx_patient"), P), R.person)


@query("target_distribution", f"""
select count(*) total, count(*) filter (where s = 'Alive') alive, count(*) filter (where s = 'Expired') expired,
  count(*) filter (where s is null or s = '') missing,
  count(*) filter (where s not in ('Alive', 'Expired', '')) other,
  {d(pct("count(*) filter (where s = 'Alive')", "count(*)"), "alive_pct")},
  {d(pct("count(*) filter (where s = 'Expired')", "count(*)"), "expired_pct")},
  {d(pct("count(*) filter (where s is null or s = '')", "count(*)"), "missing_pct")},
  count(*) filter (where s in ('Alive', 'Expired')) known,
  {d(pct("count(*) filter (where s = 'Expired')", "count(*) filter (where s in ('Alive', 'Expired'))"), "prevalence_pct")}
from (select hospitaldischargestatus s from fx_patient)""")
def _(spark, sf):
    return profile.outcome_distribution(view(spark, sf, "fx_patient"), R.outcome)


def window_sql(name, source, offset):
    parts = {"pre_icu": f"{offset} < 0", "first_24h": f"{offset} between 0 and 1440", "post_24h": f"{offset} > 1440"}
    return (f"select '{name}' table_name, count(*) records, "
            + ", ".join(f"count(*) filter (where {w}) {k}_count" for k, w in parts.items()) + ", "
            + ", ".join(d(pct(f"count(*) filter (where {w})", "count(*)"), f"{k}_pct") for k, w in parts.items())
            + f" from {source}")


@query("temporal_summary", window_sql("lab", "fx_lab", "labresultoffset") + " union all "
       + window_sql("vital", "fx_vital", "observationoffset"))
def _(spark, sf):
    t = tables(spark, sf)
    return profile.temporal_summary(t.lab, R.long_offset, "lab").unionByName(
        profile.temporal_summary(t.vital, R.wide_offset, "vital"))


PATIENT_MISSING = {"patientunitstayid": 0, "hospitaladmitoffset": 0, "uniquepid": 0, "patienthealthsystemstayid": 0, "unitvisitnumber": 0,
                   "unitdischargeoffset": 0, "age": 1, "gender": 1, "ethnicity": 1, "unittype": 1, "unitadmitsource": 1,
                   "admissionweight": 0, "admissionheight": 0, "hospitaldischargestatus": 1, "unitdischargestatus": 1}


def missing_sql(table, source, column, text):
    test = f"{column} is null or {column} = ''" if text else f"{column} is null"
    return (f"select '{table}' table_name, '{column}' column_name, count(*) filter (where {test}) null_count, "
            f"{d(pct(f'count(*) filter (where {test})', 'count(*)'), 'missing_pct')} from {source}")


@query("missingness_profile", " union all ".join(
    [missing_sql("patient", "fx_patient", c, t) for c, t in PATIENT_MISSING.items()]
    + [missing_sql("vital", "fx_vital", c, 0) for c in FEATURES.wide]))
def _(spark, sf):
    t = tables(spark, sf)
    return profile.missingness(t.patient, t.patient.columns, "patient").unionByName(
        profile.missingness(t.vital, list(FEATURES.wide), "vital"))


@query("lab_missingness", f"""
select labname, count(*) total_ordered, count(*) filter (where labresult is null) null_results,
  {d(pct("count(*) filter (where labresult is null)", "count(*)"), "missing_pct")}
from lbound where low is not null group by labname""")
def _(spark, sf):
    return profile.long_missingness(view(spark, sf, "fx_lab"), R.long_name, R.long_value, [b.name for b in P.long_bounds])


@query("plausibility_wide", " union all ".join(f"""
select '{b.name}' signal, {b.low}::double low, {b.high}::double high, count({b.name}) total_non_null,
  count(*) filter (where {b.name} < 0) negative_count, count(*) filter (where {b.name} < {b.low} or {b.name} > {b.high}) out_of_bounds,
  {d(pct(f"count(*) filter (where {b.name} < {b.low} or {b.name} > {b.high})", f"count({b.name})"), "out_of_bounds_pct")}
from fx_vital""" for b in P.wide_bounds))
def _(spark, sf):
    return profile.plausibility_wide(view(spark, sf, "fx_vital"), P.wide_bounds)


@query("plausibility_long", f"""
select labname, low, high, count(*) total_non_null, count(*) filter (where labresult < 0) negative_count,
  count(*) filter (where labresult < low or labresult > high) out_of_bounds,
  {d(pct("count(*) filter (where labresult < low or labresult > high)", "count(*)"), "out_of_bounds_pct")}
from lbound where low is not null and labresult is not null group by labname, low, high""")
def _(spark, sf):
    return profile.plausibility_long(view(spark, sf, "fx_lab"), R.long_name, R.long_value, P.long_bounds)


def flags(spark, sf):
    t = tables(spark, sf)
    return profile.quality_flags(P, t.patient, t.lab, t.vital)


@query("quality_flags", f"""
select patientunitstayid, flag_missing_demographics, flag_missing_target, flag_missing_lab_data, flag_missing_vital_data,
  flag_possible_invalid_value, flag_temporal_issue, {d("experimental_completeness_pct")} from qflags""")
def _(spark, sf):
    return flags(spark, sf)


@query("quality_flag_summary", " union all ".join(
    f"select '{f}' flag, count(*) filter (where {f}) entities, {d(pct(f'count(*) filter (where {f})', 'count(*)'), 'pct')} from qflags"
    for f in profile.ALL_FLAGS))
def _(spark, sf):
    return profile.flag_summary(flags(spark, sf))


@query("invalid_keys_union", """
select patientunitstayid from lab_bad where bad union select patientunitstayid from vital_bad where bad""")
def _(spark, sf):
    t = tables(spark, sf)
    return profile.invalid_keys(P, t.lab, t.vital)


@query("clean_entities", """
select count(*) entities, count(*) filter (where c) clean_entities, 100.0::double * count(*) filter (where c) / count(*) clean_pct
from (select bool_and(regexp_matches(lower(flag_missing_demographics::varchar), 'no_warnings|pass|ok|clean|valid|no_warning')) c
      from qflags group by patientunitstayid)""")
def _(spark, sf):
    return profile.clean_entities(flags(spark, sf), KEY, "flag_missing_demographics", presets.CLEAN_WORDS)


@query("keyword_flag", f"""
select uniquepid, {d("avg(c::int)", "clean_frac")}, bool_and(c) all_clean
from (select uniquepid, regexp_matches(lower(unittype), 'build|house') c from fx_patient) group by uniquepid""")
def _(spark, sf):
    return profile.keyword_clean(view(spark, sf, "fx_patient"), "uniquepid", "unittype", ("build", "house"))


@query("value_counts", """
select unitadmitsource "value", count(*) n from fx_patient group by 1 order by n desc, 1 nulls first limit 10""")
def _(spark, sf):
    return profile.value_counts(view(spark, sf, "fx_patient"), "unitadmitsource")


TOP_NAMES_SQL = """
select labname, count(*) record_count, count(distinct patientunitstayid) entity_count,
  count(*) filter (where labresult is null) missing_results
from fx_lab group by labname order by record_count desc, labname limit 20"""


@query("top_names", TOP_NAMES_SQL)
def _(spark, sf):
    return profile.top_names(view(spark, sf, "fx_lab"), R.long_name, KEY, R.long_value)


@query("top_names_bitmap", TOP_NAMES_SQL)
def _(spark, sf):
    return profile.top_names(view(spark, sf, "fx_lab"), R.long_name, KEY, R.long_value, how="bitmap")


DESCRIBED = ["admissionweight", "admissionheight", "unitdischargeoffset"]


@query("describe_numeric", " union all ".join(f"""
select '{c}' column_name, count({c}) "count", count(*) - count({c}) null_count, {d(f"avg({c})", "mean")}, {d(f"stddev_samp({c})", "std")},
  {d(f"min({c})", "min")}, {d(f"max({c})", "max")}, {d(f"quantile_cont({c}::double, 0.25)", "p25")},
  {d(f"quantile_cont({c}::double, 0.5)", "p50")}, {d(f"quantile_cont({c}::double, 0.75)", "p75")} from fx_patient""" for c in DESCRIBED))
def _(spark, sf):
    return profile.describe_numeric(view(spark, sf, "fx_patient"), DESCRIBED)


@query("age_composition", f"""
with a as (select age, age is null or age = '' m, age = '> 89' g,
  case when age <> '' and age <> '> 89' then try_cast(age as double) end v from fx_patient)
select count(*) total, count(*) filter (where not m and not g) numeric_count,
  {d(pct("count(*) filter (where not m and not g)", "count(*)"), "numeric_pct")},
  count(*) filter (where g) capped_count, {d(pct("count(*) filter (where g)", "count(*)"), "capped_pct")},
  count(*) filter (where m) missing_count, {d(pct("count(*) filter (where m)", "count(*)"), "missing_pct")},
  {d("avg(v)", "mean_age")}, {d("min(v)", "min_age")}, {d("max(v)", "max_age")} from a""")
def _(spark, sf):
    return profile.age_composition(view(spark, sf, "fx_patient"), "age", "> 89")


@query("histogram", f"""
select b::bigint bin, {d("b * 4.0", "bin_low")}, {d("(b + 1) * 4.0", "bin_high")}, count(v)  n
from range(25) t(b) left join (select age_numeric v from enc where age_numeric between 0 and 100) on least(floor(v / 4.0), 24) = b group by b""")
def _(spark, sf):
    aged = clean.harmonize_age(clean.encode_outcome(view(spark, sf, "fx_patient"), R.outcome), "age")
    return profile.histogram(aged, "age_numeric", 0.0, 100.0, 25)


def label_case() -> str:
    cases = [f"when starts_with(f, '{p}_') then '{t}: ' || replace(f, '{p}_', '')" for p, t in presets.CATEGORY_LABELS.items()]
    cases += [f"when f = '{e}' then '{t}'" for e, t in presets.EXACT_LABELS.items()]
    for prefix, text in presets.MEASURE_LABELS.items():
        suffix = f"substr(f, {len(prefix) + 2})"
        stats = " ".join(f"when '{s}' then '{t}'" for s, t in presets.STATISTIC_LABELS.items())
        cases.append(f"when starts_with(f, '{prefix}_') then '{text} (' || case {suffix} {stats} else "
                     f"upper(substr({suffix}, 1, 1)) || lower(substr({suffix}, 2)) end || ')'")
    return "case " + " ".join(cases) + " else upper(substr(f, 1, 1)) || lower(substr(f, 2)) end"


ALL_FEATURES = [c for cols in measures.feature_groups(FEATURES).values() for c in cols]


@query("feature_labels", "with counted as (select " + ", ".join(f"count({c}) {c}" for c in ALL_FEATURES) + " from ftable), long as ("
       + " union all ".join(f"select '{c}' f, {c} k from counted" for c in ALL_FEATURES)
       + " union all select 'cat__gender_' || gender, count(*) from admission group by gender"
       + " union all select 'cat__unittype_' || unittype, count(*) from admission group by unittype"
       + " union all select 'cat__unitadmitsource_' || unitadmitsource, count(*) from admission group by unitadmitsource"
       + f") select raw feature, {label_case()} label, k filled_rows from (select f raw, replace(replace(f, 'num__', ''), 'cat__', '') f, k from long)")
def _(spark, sf):
    features = steps.build_features(tables(spark, sf), P)
    filled = profile.feature_manifest(features, measures.feature_groups(FEATURES)).select("feature", "filled_rows")
    levels = features.select(F.inline(F.array(*[
        F.struct(F.concat(F.lit(f"cat__{c}_"), F.col(c)).alias("feature")) for c in ("gender", "unittype", "unitadmitsource")])))
    named = filled.unionByName(levels.groupBy("feature").agg(F.count(F.lit(1)).alias("filled_rows")))
    return named.select("feature", attribution.display_name(F.col("feature")).alias("label"), "filled_rows")
