"""Registry of queries and their SQL, and the shared SQL steps."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from checks.views import VIEWS, view, view_sql
from cohortmill import presets
from cohortmill.config import Features
from cohortmill.operators import measures
from cohortmill.plans.steps import Tables
from cohortmill.session import configure

P = presets.ICU
R = P.roles
FEATURES: Features = P.features

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
STEPS: dict[str, str] = {name: view_sql(name, "duckdb") for name in VIEWS}


# Added before rounding on both engines: an exact tie at the seventh decimal is
# rounded by value on one and by its binary neighbour on the other.
NUDGE = 3e-10


def tidy(df: DataFrame) -> DataFrame:
    """Types the comparison uses: bigint counts, doubles rounded to 6 places."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            out.append(f"round(cast(`{f.name}` as double) + {NUDGE}D, 6) + 0.0D as `{f.name}`")
        elif isinstance(f.dataType, T.IntegralType):
            out.append(f"cast(`{f.name}` as bigint) as `{f.name}`")
        else:
            out.append(f"`{f.name}`")
    return df.selectExpr(*out)


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` may refer to any shared step by name."""
    def add(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return tidy(build(spark, sf_dir))
        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = expand(sql)
        return build
    return add


def step(name: str, sql: str) -> None:
    STEPS[name] = sql.strip()


def expand(sql: str) -> str:
    """Put the steps that a text refers to in front of it as CTEs."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in STEPS:
            if name not in order and re.search(rf"\b{name}\b", text):
                visit(STEPS[name])
                if name not in order:
                    order.append(name)

    body = sql.strip()
    visit(body)
    ctes = ",\n".join(f"{n} as (\n{STEPS[n]}\n)" for n in order)
    if not ctes:
        return body
    if body.lower().startswith("with recursive "):
        return f"with recursive {ctes},\n{body[15:]}"
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"


def d(expression: str, name: str | None = None) -> str:
    """SQL of a rounded double."""
    return f"round(cast({expression} as double) + {NUDGE}::double, 6) + 0.0 as {name or expression}"


def as_double(df: DataFrame, *columns: str) -> DataFrame:
    """Whole numbers that may be null, as doubles: clients show those alike."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def n(expression: str, name: str | None = None) -> str:
    """SQL of a whole number."""
    return f"cast({expression} as bigint) as {name or expression}"


def pct(num: str, den: str) -> str:
    return f"case when {den} > 0 then 100.0 * {num} / {den} else 0.0 end"


def ratio(num: str, den: str) -> str:
    return f"case when {den} > 0 then ({num})::double / ({den}) else 0.0 end"


def tables(spark: SparkSession, sf: str) -> Tables:
    return Tables(view(spark, sf, "fx_patient"), view(spark, sf, "fx_lab"), view(spark, sf, "fx_vital"))


# --- shared SQL steps -----------------------------------------------------------------

step("enc", """
select *, case when hospitaldischargestatus = 'Expired' then 1 else 0 end hospital_mortality,
  case when age = '> 89' then 1 when age is null or age = '' then null else 0 end age_gt89,
  case when age = '> 89' then 90.0::double when age is null or age = '' then null else try_cast(age as double) end age_numeric
from fx_patient where hospitaldischargestatus in ('Alive', 'Expired')""")

step("cohort", "select * from enc where unitvisitnumber = 1 and unitdischargeoffset >= 1440")

step("vmask", "select patientunitstayid, observationoffset, " + ", ".join(
    f"case when {b.name} between {b.low} and {b.high} then {b.name} end {b.name}" for b in P.wide_bounds) + " from fx_vital")

LAB_LOW = "case labname " + " ".join(f"when '{b.name}' then {b.low}::double" for b in P.long_bounds) + " end"
LAB_HIGH = "case labname " + " ".join(f"when '{b.name}' then {b.high}::double" for b in P.long_bounds) + " end"
step("lbound", f"select *, {LAB_LOW} low, {LAB_HIGH} high from fx_lab")
step("lmask", """
select patientunitstayid, labresultoffset, labname, labid,
  case when labresult < low or labresult > high then null else labresult end labresult_num from lbound""")

step("vfeat", "select patientunitstayid, " + ", ".join(
    f"avg({c}) {c}_mean, min({c}) {c}_min, max({c}) {c}_max, stddev_samp({c}) {c}_std, count({c}) {c}_count"
    for c in FEATURES.wide) + ", count(*) vital_measurement_count from vmask "
    "where observationoffset between 0 and 1440 group by patientunitstayid")


def lab_aggregates() -> str:
    parts = []
    for raw, p in FEATURES.long:
        hit = f"filter (where labname = '{raw}' and labresult_num is not null)"
        parts += [f"first(labresult_num order by labresultoffset, labid) {hit} {p}_first",
                  f"last(labresult_num order by labresultoffset, labid) {hit} {p}_last",
                  f"min(labresult_num) {hit} {p}_min", f"max(labresult_num) {hit} {p}_max",
                  f"avg(labresult_num) {hit} {p}_mean", f"nullif(count(*) {hit}, 0) {p}_count"]
    return ", ".join(parts)


step("lfeat", f"""
select patientunitstayid, count(*) lab_measurement_count, {lab_aggregates()}
from lmask where labresultoffset between 0 and 1440 group by patientunitstayid""")

step("admission", """
select patientunitstayid, patienthealthsystemstayid, hospital_mortality, age_numeric, age_gt89,
  coalesce(nullif(gender, ''), 'Unknown') gender, coalesce(nullif(ethnicity, ''), 'Unknown') ethnicity,
  admissionheight, admissionweight, unittype, coalesce(nullif(unitadmitsource, ''), 'Unknown') unitadmitsource
from cohort""")

GROUPS = measures.feature_groups(FEATURES)
CLINICAL = measures.clinical_columns(FEATURES)
COUNTS = measures.count_columns(FEATURES)
ADMISSION = list(FEATURES.admission)
VALUES = GROUPS["vital_clinical_features"] + GROUPS["lab_clinical_features"]
step("ftable0", "select a.*, " + ", ".join(VALUES) + ", " + ", ".join(
    f"coalesce({c}, 0) {c}" for c in COUNTS) + """
from admission a left join vfeat using (patientunitstayid) left join lfeat using (patientunitstayid)""")
step("ftable", "select *, " + " + ".join(f"({c}_count > 0)::int" for c in FEATURES.wide) + " available_vital_count, "
     + " + ".join(f"({p}_count > 0)::int" for _, p in FEATURES.long) + " available_lab_count, "
     + " + ".join(f"({c} is null)::int" for c in CLINICAL) + " missing_feature_count from ftable0")

step("lab_bad", """
select patientunitstayid, bool_or(coalesce(labresult < low or labresult > high, false)) bad
from lbound where labresultoffset between 0 and 1440 group by patientunitstayid""")
step("vital_bad", "select patientunitstayid, bool_or(" + " or ".join(
    f"coalesce({b.name} < {b.low} or {b.name} > {b.high}, false)" for b in P.wide_bounds) + """) bad
from fx_vital where observationoffset between 0 and 1440 group by patientunitstayid""")
step("qflags0", """
select p.patientunitstayid,
  (age is null or age = '' or gender is null or gender = '' or ethnicity is null or ethnicity = '') flag_missing_demographics,
  (hospitaldischargestatus is null or hospitaldischargestatus = '') flag_missing_target,
  l.bad is null flag_missing_lab_data, v.bad is null flag_missing_vital_data,
  coalesce(l.bad, false) or coalesce(v.bad, false) flag_possible_invalid_value
from fx_patient p left join lab_bad l using (patientunitstayid) left join vital_bad v using (patientunitstayid)""")
step("qflags", """
select *, flag_missing_lab_data and flag_missing_vital_data flag_temporal_issue,
  round((1.0::double - (flag_missing_demographics::int + flag_missing_target::int + flag_missing_lab_data::int
    + flag_missing_vital_data::int + flag_possible_invalid_value::int) / 5.0::double) * 100.0, 1) experimental_completeness_pct
from qflags0""")

# Spread and quality cuts used where thresholds are given, not chosen.
SPREAD_CUT, QUALITY_CUT = 0.19, 0.45
