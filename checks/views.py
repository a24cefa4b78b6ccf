"""The library's input roles as views over the test tables, for both engines.

One SQL text per view. The engines differ only in the fragments below. The
visit number is arithmetic on the keys instead of a rank per customer, so that
no view sorts a customer's orders in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FRAGMENTS = {
    "spark": {
        "days": "datediff(l_shipdate, o_orderdate)",
        "text": "string",
        "reps": "lateral view explode(array(0, 1, 2, 3, 4)) r as rep",
        "unit": "conv(substr(md5(cast({} as string)), 1, 8), 16, 10) / 4294967296.0D",
    },
    "duckdb": {
        "days": "date_diff('day', o_orderdate, l_shipdate)",
        "text": "varchar",
        "reps": "cross join unnest([0, 1, 2, 3, 4]) r(rep)",
        "unit": "(('0x' || substr(md5(cast({} as varchar)), 1, 8))::bigint / 4294967296.0)::double",
    },
}

PATIENT = """
select o_orderkey patientunitstayid, o_custkey uniquepid,
  o_custkey * 10 + year(o_orderdate) % 10 patienthealthsystemstayid,
  cast(-((o_orderkey * 11) % 13) as bigint) hospitaladmitoffset,
  cast(1 + (o_orderkey * 7 + o_custkey) % 3 as int) unitvisitnumber,
  cast(floor(o_totalprice / 100) as bigint) unitdischargeoffset,
  case when o_custkey % 50 = 0 then null when c_acctbal < 0 then '' when c_acctbal > 9000 then '> 89'
       else cast(18 + o_custkey % 72 as <text>) end age,
  case when o_custkey % 40 = 0 then '' when o_custkey % 2 = 0 then 'Female' else 'Male' end gender,
  case when o_custkey % 25 = 0 then null else cast(c_nationkey as <text>) end ethnicity,
  c_mktsegment unittype, case when o_orderkey % 60 = 0 then '' else o_orderpriority end unitadmitsource,
  case when o_orderkey % 12 = 0 then null else 40 + o_totalprice / 4000 end admissionweight,
  case when o_orderkey % 30 = 0 then null else 150 + c_acctbal / 250 end admissionheight,
  case when o_orderstatus = 'F' and o_orderpriority = '1-URGENT' then 'Expired'
       when o_orderstatus = 'P' and o_orderpriority = '1-URGENT' then null
       when o_orderstatus = 'P' and o_orderpriority = '2-HIGH' then '' else 'Alive' end hospitaldischargestatus,
  case when o_orderstatus = 'F' and o_orderpriority = '1-URGENT' and o_orderkey % 2 = 0 then 'Expired'
       else 'Alive' end unitdischargestatus
from <orders> join <customer> on o_custkey = c_custkey
"""

VITAL = """
select case when l_suppkey % 7 = 0 then -l_orderkey else l_orderkey end patientunitstayid,
  cast(((<days> * 7 + l_linenumber * 13) % 2880 + 2880) % 2880 - 480 as bigint) observationoffset,
  l_quantity * 6 heartrate, 100 - l_discount * 600 sao2, l_tax * 1000 respiration,
  case when l_linenumber < 6 then null else 25 + l_quantity * 0.4 end temperature,
  case when l_returnflag = 'R' then l_extendedprice / 300 - 20 end systemicsystolic,
  case when l_returnflag = 'R' then l_extendedprice / 500 - 10 end systemicdiastolic,
  case when l_returnflag = 'R' then l_extendedprice / 400 - 15 end systemicmean
from <lineitem> join <orders> on l_orderkey = o_orderkey
"""

LAB = """
select l_orderkey patientunitstayid,
  cast((((<days> * 5 + l_linenumber * 29 + l_suppkey * 3 + rep * 7) % 48 + 48) % 48 - 8) * 60 + case when l_partkey % 5 = 0 then 6000 else 0 end as bigint) labresultoffset,
  case (l_partkey + rep % 2) % 16 when 0 then 'creatinine' when 1 then 'BUN' when 2 then 'sodium' when 3 then 'potassium'
    when 4 then 'glucose' when 5 then 'Hgb' when 6 then 'Hct' when 7 then 'WBC x 1000' when 8 then 'platelets x 1000'
    when 9 then 'bicarbonate' when 10 then 'chloride' when 11 then 'calcium' when 12 then 'magnesium'
    when 13 then 'lactate' when 14 then 'pH' when 15 then 'bedside glucose' end labname,
  case when (l_suppkey + rep) % 40 = 0 then null else l_quantity * 4 + rep end labresult,
  l_partkey * 100000 + l_suppkey * 100 + l_linenumber * 10 + rep labid
from <lineitem> join <orders> on l_orderkey = o_orderkey <reps>
"""

SCORED = """
select patientunitstayid, uniquepid, unittype, y,
  round(least(0.999, greatest(0.001, 0.02 + 0.35 * u * u + 0.25 * y * u)), 3) p,
  round(0.05 + 0.25 * u2, 3) ustd, round(0.3 + 0.7 * u3, 3) dq
from (select patientunitstayid, uniquepid, unittype,
        case when hospitaldischargestatus = 'Expired' then 1 else 0 end y,
        <unit:patientunitstayid> u, <unit:patientunitstayid + 1000003> u2, <unit:patientunitstayid + 2000003> u3
      from <fx_patient> where hospitaldischargestatus in ('Alive', 'Expired')) s
"""

#: The same scores unrounded, but for every fifth row: nearly all differ, some tie.
SCORED_FULL = """
select patientunitstayid, unittype, y, case when patientunitstayid % 5 = 0 then round(p, 2) else p end p, ustd, dq
from (select patientunitstayid, unittype, y,
        least(0.999, greatest(0.001, 0.02 + 0.35 * u * u + 0.25 * y * u)) p, 0.05 + 0.25 * u2 ustd, 0.3 + 0.7 * u3 dq
      from (select patientunitstayid, unittype,
              case when hospitaldischargestatus = 'Expired' then 1 else 0 end y,
              <unit:patientunitstayid> u, <unit:patientunitstayid + 1000003> u2, <unit:patientunitstayid + 2000003> u3
            from <fx_patient> where hospitaldischargestatus in ('Alive', 'Expired')) r) s
"""

VIEWS = {"fx_patient": PATIENT, "fx_vital": VITAL, "fx_lab": LAB, "fx_scored": SCORED, "fx_full": SCORED_FULL}
BASE = ("orders", "customer", "lineitem")


def view_sql(name: str, engine: str, names: dict[str, str] | None = None) -> str:
    """SQL of a view; ``names`` maps input tables to what the engine calls them."""
    text = VIEWS[name]
    parts = FRAGMENTS[engine]
    for key in ("days", "text", "reps"):
        text = text.replace(f"<{key}>", parts[key])
    while "<unit:" in text:
        start = text.index("<unit:")
        end = text.index(">", start)
        text = text[:start] + parts["unit"].format(text[start + 6:end]) + text[end + 1:]
    for table in (*BASE, "fx_patient"):
        text = text.replace(f"<{table}>", (names or {}).get(table, table))
    return text.strip()


_READ: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; the file listing and schema are read once per session."""
    key = (f"{spark.sparkContext.applicationId}:{id(spark)}", f"{sf_dir}/{name}.parquet")
    if key not in _READ:
        _READ[key] = spark.read.parquet(key[1])
    return _READ[key]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a lazy DataFrame over the Parquet tables."""
    text = view_sql(name, "spark", {t: "{" + t + "}" for t in (*BASE, "fx_patient")})
    inputs = {t: table(spark, sf_dir, t) for t in BASE if "{" + t + "}" in text}
    if "{fx_patient}" in text:
        inputs["fx_patient"] = view(spark, sf_dir, "fx_patient")
    return spark.sql(text, **inputs)
