"""Data-set profiling: schemas, keys, windows, missingness, plausibility, flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from cohortmill.config import Bound, ObservationWindow, Outcome, Preset
from cohortmill.functions.columns import (
    add_all, as_int, contains_any, count_true, is_missing, lenient_double, outside, percent, share,
    sql_text,
)
from cohortmill.operators.clean import time_flags, with_bounds
from cohortmill.operators.running import same_keys, wide_quantiles
from cohortmill.presets import LEAKAGE_PARTS


def long_table(row: DataFrame, structs: list[Column]) -> DataFrame:
    """Turn one wide row of aggregates into one row per struct."""
    return row.select(F.inline(F.array(*structs)))


def unpivot(row: DataFrame, rows: list[str]) -> DataFrame:
    """The same for many rows: each is the SQL text of a struct's fields."""
    return row.select(F.expr("inline(array(" + ", ".join(f"struct({r})" for r in rows) + "))"))


def missing_sql(df: DataFrame, name: str) -> str:
    """SQL text of :func:`is_missing`."""
    blank = f" or `{name}` = ''" if isinstance(df.schema[name].dataType, T.StringType) else ""
    return f"`{name}` is null{blank}"


# --- schema and leakage -------------------------------------------------------

def schema_check(tables: dict[str, DataFrame], required: dict[str, tuple[str, ...]],
                 strict: bool = False) -> DataFrame:
    """Per table: rows, columns, required and missing columns, status."""
    missing = {t: [c for c in cols if c not in tables[t].columns] for t, cols in required.items()}
    if strict and any(missing.values()):
        raise ValueError(f"required columns are missing: { {t: m for t, m in missing.items() if m} }")
    out = None
    for table, cols in required.items():
        part = tables[table].agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(table).alias("table_name"), "rows",
            F.lit(len(tables[table].columns)).cast("bigint").alias("total_columns"),
            F.lit(len(cols)).cast("bigint").alias("required_columns"),
            F.lit(",".join(missing[table])).alias("missing_columns"),
            F.lit("FAIL" if missing[table] else "PASS").alias("status"))
        out = part if out is None else out.unionByName(part)
    return out


def leaking_columns(columns: list[str], parts: tuple[str, ...] = LEAKAGE_PARTS) -> list[str]:
    return [c for c in columns if any(part in c.lower() for part in parts)]


def leakage_audit(df: DataFrame, audited: tuple[tuple[str, str], ...],
                  identifiers: tuple[str, ...]) -> DataFrame:
    """The audited columns: category, whether present, and filled rows of this table."""
    listed = [*audited, *[(c, "Surrogate Identifier") for c in identifiers]]
    filled = df.agg(*[
        (F.count_if(~is_missing(df, c)) if c in df.columns else F.lit(0).cast("bigint")).alias(f"n{i}")
        for i, (c, _) in enumerate(listed)], F.count(F.lit(1)).alias("rows"))
    return long_table(filled, [F.struct(
        F.lit(c).alias("column_name"), F.lit(kind).alias("category"),
        F.lit(c in df.columns).alias("present"),
        F.lit(bool(leaking_columns([c]))).alias("name_is_leaking"),
        F.col(f"n{i}").alias("filled_rows")) for i, (c, kind) in enumerate(listed)])


def feature_manifest(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Long manifest (group, feature, position) with the filled rows of each feature."""
    listed = [(g, c, i) for g, cols in groups.items() for i, c in enumerate(cols)]
    filled = df.agg(*[F.expr(f"count(`{c}`) as `f_{c}`") for _, c, _ in listed])
    return unpivot(filled, [
        f"{sql_text(g)} as feature_group, {sql_text(c)} as feature, {i} as position, `f_{c}` as filled_rows"
        for g, c, i in listed])


def model_table_report(df: DataFrame, key: str, target: str, groups: dict[str, list[str]]) -> DataFrame:
    """Uniqueness, label domain, balance and leakage of a feature table in one row."""
    per_key = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(target) == 1).alias("pos"),
        F.count_if(F.col(target) == 0).alias("neg"),
        F.count_if(~F.coalesce(F.col(target).isin(0, 1), F.lit(False))).alias("bad"))
    features = [c for cols in groups.values() for c in cols]
    rows = F.coalesce(F.sum("n"), F.lit(0))
    return per_key.agg(
        rows.alias("total_rows"), F.count(F.lit(1)).alias("unique_entities"),
        (rows == F.count(F.lit(1))).alias("one_row_per_entity"),
        F.coalesce(F.sum("neg"), F.lit(0)).alias("alive"), F.coalesce(F.sum("pos"), F.lit(0)).alias("expired"),
        percent(F.sum("pos"), rows).alias("prevalence_pct"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("invalid_labels"),
        F.lit(len(leaking_columns(df.columns))).cast("bigint").alias("leaking_columns"),
        F.lit(len(features)).cast("bigint").alias("total_features"))


def require_model_table(report: DataFrame) -> None:
    """Raise when a model table report shows a broken invariant."""
    row = report.first()
    broken = [text for text, bad in (
        ("duplicate entities", not row["one_row_per_entity"]),
        ("labels outside 0/1", row["invalid_labels"] > 0),
        ("leaking columns", row["leaking_columns"] > 0)) if bad]
    if broken:
        raise ValueError("model table check failed: " + ", ".join(broken))


# --- keys -----------------------------------------------------------------

def duplicate_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, and rows whose key occurs more than once."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
                     F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("repeated"))


def orphan_records(child: DataFrame, parent: DataFrame, key: str, name: str) -> DataFrame:
    """Records, keys and the part of both that has no parent row.

    Children are counted per key before the join, so the join moves one row per
    key and a key holding most records weighs no more than any other.
    """
    per_key = child.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    known = parent.where(F.col(key).isNotNull()).groupBy(key).agg(F.lit(True).alias("known"))
    joined = per_key.join(known, key, "left")
    orphan = F.col("known").isNull()
    return joined.agg(
        F.lit(name).alias("table_name"), F.coalesce(F.sum("n"), F.lit(0)).alias("records"),
        F.count(key).alias("entities"),
        F.coalesce(F.sum(F.when(orphan, F.col("n"))), F.lit(0)).alias("orphan_records"),
        F.count_if(orphan & F.col(key).isNotNull()).alias("orphan_entities"))


def key_coverage(child: DataFrame, parent: DataFrame, key: str, name: str) -> DataFrame:
    """Parent keys that have at least one child record."""
    seen = child.where(F.col(key).isNotNull()).groupBy(key).agg(F.lit(1).alias("seen"))
    return parent.select(key).distinct().join(seen, key, "left").agg(
        F.lit(name).alias("table_name"), F.count(key).alias("parents"),
        F.count("seen").alias("covered"), percent(F.count("seen"), F.count(key)).alias("coverage_pct"))


def identifier_validation(preset: Preset, patient: DataFrame, lab: DataFrame, vital: DataFrame) -> DataFrame:
    """Null keys, duplicate entity rows, orphans and repeated measurements, long form.

    Orphans are the rows whose entity the patient table doesn't hold, those without one included;
    the patient table itself has none.
    """
    r = preset.roles
    checks = [("patient", patient, [r.entity]), ("lab", lab, [r.entity, r.long_name, r.long_offset]),
              ("vital", vital, [r.entity, r.wide_offset])]
    out = None
    for name, df, keys in checks:
        null_keys = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(
            F.coalesce(F.sum(F.when(F.col(r.entity).isNull(), F.col("n"))), F.lit(0)).alias("null_keys"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
            F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("repeated_rows"))
        if name == "patient":
            counted = null_keys.withColumn("orphan_rows", F.lit(0).cast("bigint"))
        else:
            counted = null_keys.crossJoin(F.broadcast(orphan_records(df, patient, r.entity, name).select(
                F.col("orphan_records").alias("orphan_rows"))))
        part = counted.select(F.lit(name).alias("table_name"), "rows", "null_keys", "orphan_rows", "repeated_rows",
                              percent(F.col("repeated_rows"), F.col("rows")).alias("repeated_pct"))
        out = part if out is None else out.unionByName(part)
    return out


def identifier_hierarchy(df: DataFrame, levels: list[str]) -> DataFrame:
    """Per identifier: rows, distinct values, rows of repeated values, mean rows per value."""
    out = None
    for level in levels:
        sizes = df.groupBy(level).agg(F.count(F.lit(1)).alias("n"))
        part = sizes.agg(
            F.lit(level).alias("identifier"), F.sum("n").alias("total_rows"),
            F.count(F.lit(1)).alias("unique_count"),
            F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_rows"),
            (F.sum("n") / F.count(F.lit(1))).alias("mean_rows"))
        out = part if out is None else out.unionByName(part)
    return out


def repeat_entities(df: DataFrame, group: str) -> DataFrame:
    """Groups, groups with more than one row, and the largest group."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).agg(
        F.count(F.lit(1)).alias("persons"), F.count_if(F.col("n") > 1).alias("repeat_persons"),
        F.max("n").alias("max_stays"))


# --- outcome, time, missingness, plausibility ---------------------------------

def outcome_distribution(df: DataFrame, outcome: Outcome) -> DataFrame:
    c = F.col(outcome.column)
    total = F.count(F.lit(1))
    alive, dead = F.count_if(c == outcome.negative), F.count_if(c == outcome.positive)
    missing = F.count_if(is_missing(df, outcome.column))
    return df.agg(
        total.alias("total"), alive.alias("alive"), dead.alias("expired"), missing.alias("missing"),
        (total - alive - dead - missing).alias("other"),
        percent(alive, total).alias("alive_pct"), percent(dead, total).alias("expired_pct"),
        percent(missing, total).alias("missing_pct"), (alive + dead).alias("known"),
        percent(dead, alive + dead).alias("prevalence_pct"))


def temporal_summary(df: DataFrame, offset: str, name: str,
                     window: ObservationWindow = ObservationWindow()) -> DataFrame:
    n = F.count(F.lit(1))
    flags = ("pre_icu", "first_24h", "post_24h")
    return time_flags(df, offset, window).agg(
        F.lit(name).alias("table_name"), n.alias("records"),
        *[F.count_if(F.col(f)).alias(f"{f}_count") for f in flags],
        *[percent(F.count_if(F.col(f)), n).alias(f"{f}_pct") for f in flags])


def missingness(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Long table (table, column, nulls, percent): one aggregation, then unpivoted."""
    present = [c for c in columns if c in df.columns]
    row = df.agg(F.count(F.lit(1)).alias("__rows"), *[
        F.expr(f"count_if({missing_sql(df, c)}) as `n_{c}`") for c in present])
    return unpivot(row, [
        f"{sql_text(name)} as table_name, {sql_text(c)} as column_name, `n_{c}` as null_count, "
        f"case when __rows > 0 then `n_{c}` * 100.0D / __rows else 0.0D end as missing_pct" for c in present])


def long_missingness(df: DataFrame, name: str, value: str, names: list[str]) -> DataFrame:
    """Ordered and null results per measurement name."""
    return df.where(F.col(name).isin(names)).groupBy(name).agg(
        F.count(F.lit(1)).alias("total_ordered"),
        F.count_if(F.col(value).isNull()).alias("null_results"),
        percent(F.count_if(F.col(value).isNull()), F.count(F.lit(1))).alias("missing_pct"))


def plausibility_counts(df: DataFrame, bounds: tuple[Bound, ...]) -> list[Column]:
    """Per signal of ``df`` the non-null, negative and out-of-bounds values, as aggregates."""
    parts = []
    for b in bounds:
        if b.name in df.columns:
            v = lenient_double(b.name)
            parts += [F.count(v).alias(f"n_{b.name}"), F.count_if(v < 0).alias(f"neg_{b.name}"),
                      F.count_if(outside(v, b.low, b.high)).alias(f"oob_{b.name}")]
    return parts


def plausibility_wide(df: DataFrame, bounds: tuple[Bound, ...], counted: DataFrame | None = None) -> DataFrame:
    """Per signal: bounds, non-null, negative and out-of-bounds values; one pass, or none with ``counted`` at hand."""
    present = [b for b in bounds if b.name in df.columns]
    counted = df.agg(*plausibility_counts(df, bounds)) if counted is None else counted
    return long_table(counted, [F.struct(
        F.lit(b.name).alias("signal"), F.lit(float(b.low)).alias("low"), F.lit(float(b.high)).alias("high"),
        F.col(f"n_{b.name}").alias("total_non_null"), F.col(f"neg_{b.name}").alias("negative_count"),
        F.col(f"oob_{b.name}").alias("out_of_bounds"),
        percent(F.col(f"oob_{b.name}"), F.col(f"n_{b.name}")).alias("out_of_bounds_pct")) for b in present])


def plausibility_long(df: DataFrame, name: str, value: str, bounds: tuple[Bound, ...]) -> DataFrame:
    """The same per bounded measurement name; names without values are absent."""
    rows = with_bounds(df, name, bounds, "inner").select(name, "low", "high", lenient_double(value).alias("v"))
    bad = F.count_if(outside(F.col("v"), F.col("low"), F.col("high")))
    return rows.where(F.col("v").isNotNull()).groupBy(name, "low", "high").agg(
        F.count(F.lit(1)).alias("total_non_null"), F.count_if(F.col("v") < 0).alias("negative_count"),
        bad.alias("out_of_bounds"), percent(bad, F.count(F.lit(1))).alias("out_of_bounds_pct"))


def cleaning_audit(labs: DataFrame, vitals: DataFrame, preset: Preset, counted: DataFrame | None = None) -> DataFrame:
    """What masking nulls in measurements that are not masked yet: one row per bounded signal and measured name.

    ``counted`` is one row of ``plausibility_counts``, if the signals have been counted already.

    ``nullified`` counts values outside the bounds, ``negative_nullified`` those of
    them below zero; ``source`` says where the bounds come from, if that is known.
    """
    known = {(t, b.name): b.source for t, bounds in (("lab", preset.long_bounds), ("vital", preset.wide_bounds))
             for b in bounds if b.source}
    wide = plausibility_wide(vitals, preset.wide_bounds, counted).withColumnRenamed("signal", "name")
    long = plausibility_long(labs, preset.roles.long_name, preset.roles.long_value, preset.long_bounds)
    both = wide.withColumn("table_name", F.lit("vital")).unionByName(
        long.withColumnRenamed(preset.roles.long_name, "name").withColumn("table_name", F.lit("lab")))
    source = F.lit(None).cast("string")
    for (table, name), text in known.items():
        source = F.when((F.col("table_name") == table) & (F.col("name") == name), F.lit(text)).otherwise(source)
    # A negative value inside its bounds stays.
    low_negative = F.when(F.col("low") >= 0, F.col("negative_count"))
    return both.select("table_name", "name", "low", "high", source.alias("source"), "total_non_null",
                       F.col("out_of_bounds").alias("nullified"), F.col("out_of_bounds_pct").alias("nullified_pct"),
                       low_negative.alias("negative_nullified"))


# --- per-entity quality flags ---------------------------------------------------

FLAGS = ("flag_missing_demographics", "flag_missing_target", "flag_missing_lab_data",
         "flag_missing_vital_data", "flag_possible_invalid_value")


def invalid_by_entity(preset: Preset, lab: DataFrame, vital: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per entity and table: any value outside its bounds inside the window."""
    r, w = preset.roles, preset.window
    wide_bad = None
    for b in preset.wide_bounds:
        if b.name in vital.columns:
            test = F.coalesce(outside(lenient_double(b.name), b.low, b.high), F.lit(False))
            wide_bad = test if wide_bad is None else wide_bad | test
    long_bad = F.coalesce(outside(lenient_double(r.long_value), F.col("low"), F.col("high")), F.lit(False))
    vitals = vital.where(F.col(r.wide_offset).between(w.start, w.end)).groupBy(r.entity).agg(
        F.bool_or(wide_bad if wide_bad is not None else F.lit(False)).alias("vital_bad"))
    inside = lab.where(F.col(r.long_offset).between(w.start, w.end))
    labs = with_bounds(inside, r.long_name, preset.long_bounds).groupBy(r.entity).agg(
        F.bool_or(long_bad).alias("lab_bad"))
    return labs, vitals


def invalid_keys(preset: Preset, lab: DataFrame, vital: DataFrame) -> DataFrame:
    """Distinct entities with an implausible value in either table."""
    labs, vitals = invalid_by_entity(preset, lab, vital)
    key = preset.roles.entity
    return (labs.where("lab_bad").select(key)
            .unionByName(vitals.where("vital_bad").select(key)).distinct())


def quality_flags(preset: Preset, patient: DataFrame, lab: DataFrame, vital: DataFrame) -> DataFrame:
    """Six flags and a completeness percentage per entity.

    Each measurement table is reduced to one row per entity before it is
    joined, so presence and plausibility come from one scan of each table.
    """
    r = preset.roles
    labs, vitals = invalid_by_entity(preset, lab, vital)
    demographics = None
    for c in preset.demographics:
        test = is_missing(patient, c)
        demographics = test if demographics is None else demographics | test
    base = patient.select(r.entity, demographics.alias(FLAGS[0]), is_missing(patient, r.outcome.column).alias(FLAGS[1]))
    joined = base.join(labs, r.entity, "left").join(vitals, r.entity, "left")
    flagged = joined.select(
        r.entity, FLAGS[0], FLAGS[1],
        F.col("lab_bad").isNull().alias(FLAGS[2]), F.col("vital_bad").isNull().alias(FLAGS[3]),
        (F.coalesce("lab_bad", F.lit(False)) | F.coalesce("vital_bad", F.lit(False))).alias(FLAGS[4]))
    failed = add_all(as_int(F.col(f)) for f in FLAGS)
    return flagged.withColumns({
        "flag_temporal_issue": F.col(FLAGS[2]) & F.col(FLAGS[3]),
        "experimental_completeness_pct": F.round((1.0 - failed / len(FLAGS)) * 100.0, 1)})


ALL_FLAGS = (FLAGS[0], FLAGS[1], FLAGS[2], FLAGS[3], "flag_temporal_issue", FLAGS[4])


def flag_summary(flags: DataFrame) -> DataFrame:
    row = flags.agg(F.count(F.lit(1)).alias("__rows"), *[F.count_if(F.col(f)).alias(f) for f in ALL_FLAGS])
    return long_table(row, [F.struct(
        F.lit(f).alias("flag"), F.col(f).alias("entities"), percent(F.col(f), F.col("__rows")).alias("pct"))
        for f in ALL_FLAGS])


def keyword_clean(flags: DataFrame, key: str, column: str, words: tuple[str, ...]) -> DataFrame:
    """Per entity: share of rows whose flag text holds a clean word, and all of them."""
    clean = contains_any(F.col(column), words)
    return flags.groupBy(key).agg(F.avg(clean.cast("int")).alias("clean_frac"), F.bool_and(clean).alias("all_clean"))


def clean_entities(flags: DataFrame, key: str, column: str, words: tuple[str, ...]) -> DataFrame:
    return keyword_clean(flags, key, column, words).agg(
        F.count(F.lit(1)).alias("entities"), F.count_if(F.col("all_clean")).alias("clean_entities"),
        percent(F.count_if(F.col("all_clean")), F.count(F.lit(1))).alias("clean_pct"))


# --- distributions ----------------------------------------------------------------

def value_counts(df: DataFrame, column: str, top: int = 10) -> DataFrame:
    return (df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc_nulls_first("value")).limit(top))


def distinct_entities(df: DataFrame, name: str, key: str, how: str = "bitmap", log2_registers: int = 12) -> DataFrame:
    """(name, entity_count): distinct keys per name, without a shuffle of the keys.

    ``bitmap`` is exact and needs whole numbers: keys set bits in pieces of
    32,768 consecutive numbers, and pieces are joined by "or", so a shuffle moves
    a piece per (name, range of keys) that occurs and task. ``sketch`` takes any
    key: a mergeable sketch per name whose relative standard error is about
    1.04 / sqrt(2 ** log2_registers), 1.6 % for 4,096 registers.
    """
    present = df.where(F.col(key).isNotNull())
    if how == "sketch":
        counted = present.groupBy(name).agg(F.hll_sketch_estimate(F.hll_sketch_agg(key, log2_registers)).alias("entity_count"))
    elif how == "bitmap":
        number = F.col(key).cast("bigint")
        pieces = present.groupBy(name, F.bitmap_bucket_number(number).alias("piece")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits"))
        counted = pieces.groupBy(name).agg(F.sum(F.bitmap_count("bits")).alias("entity_count"))
    else:
        raise ValueError(f"unknown way to count {how!r}")
    return counted


def top_names(df: DataFrame, name: str, key: str, value: str, top: int = 20, how: str = "keys") -> DataFrame:
    """Most frequent names: records, distinct entities, null results.

    ``how`` counts entities by their keys, or by ``bitmap`` or ``sketch`` (``distinct_entities``).
    """
    if how != "keys":
        sizes = df.groupBy(name).agg(F.count(F.lit(1)).alias("record_count"), F.count_if(F.col(value).isNull()).alias("missing_results"))
        most = sizes.orderBy(F.desc("record_count"), F.asc(name)).limit(top)
        counted = same_keys(most, distinct_entities(df, name, key, how), [name], "left")
        return counted.select(name, "record_count", F.coalesce("entity_count", F.lit(0)).alias("entity_count"), "missing_results").orderBy(
            F.desc("record_count"), F.asc(name))
    per_key = df.groupBy(name, key).agg(F.count(F.lit(1)).alias("n"),
                                        F.count_if(F.col(value).isNull()).alias("nulls"))
    return (per_key.groupBy(name).agg(F.sum("n").alias("record_count"), F.count(key).alias("entity_count"),
                                      F.sum("nulls").alias("missing_results"))
            .orderBy(F.desc("record_count"), F.asc(name)).limit(top))


def describe_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, nulls, mean, std, min, quartiles (exact, linear), max per column."""
    long = unpivot(df, [f"{sql_text(c)} as column_name, cast(`{c}` as double) as v" for c in columns])
    moments = long.groupBy("column_name").agg(
        F.count("v").alias("count"), F.count_if(F.col("v").isNull()).alias("null_count"),
        F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    quartiles = wide_quantiles(df, columns, [0.25, 0.5, 0.75]).select(
        F.col("feature").alias("column_name"), F.col("q0").alias("p25"), F.col("q1").alias("p50"), F.col("q2").alias("p75"))
    return same_keys(moments, quartiles, ["column_name"], "left")


def age_composition(df: DataFrame, column: str, capped_text: str) -> DataFrame:
    c = F.col(column)
    missing, capped = is_missing(df, column), c == capped_text
    numeric = ~missing & (c != capped_text)
    n = F.count(F.lit(1))
    number = F.when(numeric, lenient_double(column))
    return df.agg(
        n.alias("total"), F.count_if(numeric).alias("numeric_count"), percent(F.count_if(numeric), n).alias("numeric_pct"),
        F.count_if(capped).alias("capped_count"), percent(F.count_if(capped), n).alias("capped_pct"),
        F.count_if(missing).alias("missing_count"), percent(F.count_if(missing), n).alias("missing_pct"),
        F.avg(number).alias("mean_age"), F.min(number).alias("min_age"), F.max(number).alias("max_age"))


def rate_by_category(df: DataFrame, column: str, label: str, min_rows: int = 10, top: int = 6) -> DataFrame:
    """Outcome rate per category with at least ``min_rows`` rows, lowest first."""
    return (df.where(F.col(column).isNotNull()).groupBy(column)
            .agg(F.avg(label).alias("rate"), F.count(label).alias("n"))
            .where(F.col("n") >= min_rows).orderBy("rate", column).limit(top))


def kpi_summary(df: DataFrame, max_long: int, max_wide: int, long_breadth: int = 10, wide_breadth: int = 6) -> DataFrame:
    n = F.count(F.lit(1))
    half = F.lit(50.0)
    return df.agg(
        n.alias("entities"),
        percent(F.count_if(F.col("missing_feature_count") > 0), n).alias("any_missing_pct"),
        F.avg("missing_feature_count").alias("mean_missing"),
        percent(F.count_if(F.col("available_lab_count") >= long_breadth), n).alias("lab_breadth_pct"),
        percent(F.count_if(F.col("available_vital_count") >= wide_breadth), n).alias("vital_breadth_pct"),
        (half * F.avg("available_lab_count") / max_long + half * F.avg("available_vital_count") / max_wide)
        .alias("completeness_pct"))


def missingness_by_group(missing: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Mean missing percentage per feature category; categories come from a manifest."""
    spark = missing.sparkSession
    manifest = spark.createDataFrame([(g, c) for g, cols in groups.items() for c in cols],
                                     "category string, column_name string")
    return missing.join(F.broadcast(manifest), "column_name").groupBy("category").agg(
        F.count(F.lit(1)).alias("features"), F.avg("missing_pct").alias("mean_missing_pct"))


def missingness_bands(missing: DataFrame, top: int = 25) -> DataFrame:
    """The most incomplete features with a band label."""
    band = F.when(F.col("missing_pct") > 50, "high").when(F.col("missing_pct") > 20, "review").otherwise("acceptable")
    return (missing.where(F.col("missing_pct") > 0)
            .select("column_name", "null_count", "missing_pct", band.alias("band"))
            .orderBy(F.desc("missing_pct"), "column_name").limit(top))


def missingness_totals(missing: DataFrame) -> DataFrame:
    """How many features have any, over 20 % and over 50 % missing values."""
    share_missing = F.col("missing_pct")
    return missing.agg(
        F.count(F.lit(1)).alias("features"), F.count_if(share_missing > 0).alias("any_missing"),
        F.count_if(share_missing > 20).alias("over_20_pct"), F.count_if(share_missing > 50).alias("over_50_pct"))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts in equal bins of [low, high]; empty bins are kept, the last bin is closed."""
    step = (high - low) / bins
    edges = [low + i * step for i in range(bins)] + [high]
    value = F.col(column)
    index = add_all(F.when(value >= e, 1).otherwise(0) for e in edges[1:-1])
    counted = df.where(value.between(low, high)).groupBy(index.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    frame = df.sparkSession.createDataFrame([(i, edges[i], edges[i + 1]) for i in range(bins)],
                                            "bin int, bin_low double, bin_high double")
    return frame.join(counted, "bin", "left").select(
        "bin", "bin_low", "bin_high", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def baseline_profile(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Median of numeric and mode of categorical columns (ties to the smallest value)."""
    numbers = wide_quantiles(df, numeric, [0.5]).select(
        "feature", F.col("q0").alias("numeric_value"), F.lit(None).cast("string").alias("category_value"))
    words = unpivot(df, [f"{sql_text(c)} as feature, cast(`{c}` as string) as w" for c in categorical])
    modes = (words.where(F.col("w").isNotNull()).groupBy("feature", "w").agg(F.count(F.lit(1)).alias("n"))
             .groupBy("feature").agg(F.min(F.struct((-F.col("n")).alias("rank"), "w")).alias("m"))
             .select("feature", F.lit(None).cast("double").alias("numeric_value"), F.col("m.w").alias("category_value")))
    return numbers.unionByName(modes)
