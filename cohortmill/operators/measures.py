"""Per-entity summaries of wide and long measurements, and the feature table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from cohortmill.config import Features
from cohortmill.functions.columns import count_where, sql_text
from cohortmill.operators.clean import fill_unknown, keep_present


def wide_features(df: DataFrame, key: str, columns: tuple[str, ...],
                  total: str = "vital_measurement_count") -> DataFrame:
    """mean, min, max, sample std and count per signal, one aggregation per entity."""
    aggregates = [F.expr(text) for c in columns if c in df.columns for text in (
        f"avg(`{c}`) as `{c}_mean`", f"min(`{c}`) as `{c}_min`", f"max(`{c}`) as `{c}_max`",
        f"stddev_samp(`{c}`) as `{c}_std`", f"count(`{c}`) as `{c}_count`")]
    return df.groupBy(key).agg(*aggregates, F.count(F.lit(1)).alias(total))


def event_order(df: DataFrame, offset: str, order: str) -> Column:
    """(offset, tie-break) as one value to order by, nulls first.

    Whole numbers are packed into a decimal, which a hash aggregate can hold;
    anything else is a struct, for which Spark sorts the rows first. A whole
    offset must have at most 16 digits; more raise an error.
    """
    if not all(isinstance(df.schema[c].dataType, T.IntegralType) for c in (offset, order)):
        return F.struct(offset, order)
    at = F.expr(f"case when abs(`{offset}`) < 10000000000000000 then cast(`{offset}` as decimal(16, 0)) "
                f"when `{offset}` is null then -10000000000000000BD "
                "else cast(raise_error('offset of more than 16 digits') as decimal(16, 0)) end")
    tie = F.expr(f"coalesce(cast(`{order}` as decimal(19, 0)), -9223372036854775809BD)")
    return at * F.expr("20000000000000000000BD") + tie


def long_summaries(df: DataFrame, key: str, name: str, value: str, offset: str, order: str) -> DataFrame:
    """One row per (entity, name): first, last, min, max, sum, counts.

    First and last are those of the non-null values in the order of (offset,
    tie-break). All aggregates combine before the shuffle, so an entity with a
    large share of the rows costs one row per name and task.
    """
    at = F.when(F.col(value).isNotNull(), event_order(df, offset, order))
    return df.groupBy(key, name).agg(
        F.min_by(value, at).alias("first"), F.max_by(value, at).alias("last"),
        F.min(value).alias("min"), F.max(value).alias("max"), F.sum(value).alias("sum"),
        F.count(value).alias("count"), F.count(F.lit(1)).alias("rows"))


def long_features(df: DataFrame, key: str, name: str, value: str, offset: str, order: str,
                  selected: tuple[tuple[str, str], ...], total: str = "lab_measurement_count") -> DataFrame:
    """Wide per-entity table of the selected names.

    ``{prefix}_{first,last,min,max,mean,count}`` per name and the total number of
    rows, null results and unselected names included. A pivot by conditional
    aggregation over per-name summaries; no join per name.
    """
    names = [raw for raw, _ in selected]
    known = F.when(F.col(name).isin(*names), F.col(name))
    grouped = df.select(key, known.alias(name), value, offset, order)
    summary = long_summaries(grouped, key, name, value, offset, order)
    aggregates = []
    for raw, prefix in selected:
        hit = f"`{name}` = " + sql_text(raw)
        aggregates += [f"max(case when {hit} then `{stat}` end) as `{prefix}_{stat}`" for stat in ("first", "last", "min", "max")]
        aggregates.append(f"max(case when {hit} then `sum` / nullif(`count`, 0) end) as `{prefix}_mean`")
        aggregates.append(f"max(case when {hit} then nullif(`count`, 0) end) as `{prefix}_count`")
    return summary.groupBy(key).agg(F.sum("rows").alias(total), *[F.expr(a) for a in aggregates])


def admission_features(df: DataFrame, features: Features) -> DataFrame:
    """Identifiers, label and admission columns; blank categories become Unknown."""
    kept = keep_present(df, [*features.identifiers, features.target, *features.admission])
    return fill_unknown(kept, features.unknown_filled)


WIDE_STATS = ("mean", "min", "max", "std")
LONG_STATS = ("first", "last", "min", "max", "mean")


def feature_groups(features: Features) -> dict[str, list[str]]:
    """Manifest: feature columns by group, in table order."""
    return {
        "admission_demographics": list(features.admission),
        "vital_clinical_features": [f"{c}_{s}" for c in features.wide for s in WIDE_STATS],
        "lab_clinical_features": [f"{p}_{s}" for _, p in features.long for s in LONG_STATS],
        "vital_quality_features": [f"{c}_count" for c in features.wide] + ["vital_measurement_count"],
        "lab_quality_features": ["lab_measurement_count"] + [f"{p}_count" for _, p in features.long],
        "meta_quality_features": ["available_vital_count", "available_lab_count", "missing_feature_count"],
    }


def clinical_columns(features: Features) -> list[str]:
    groups = feature_groups(features)
    return (groups["admission_demographics"] + groups["vital_clinical_features"]
            + groups["lab_clinical_features"])


def count_columns(features: Features) -> list[str]:
    groups = feature_groups(features)
    return groups["vital_quality_features"] + groups["lab_quality_features"]


def availability(df: DataFrame, features: Features) -> DataFrame:
    """Available signals, available names and missing clinical values per row."""
    present = set(df.columns)
    wide = [f"{c}_count" for c in features.wide if f"{c}_count" in present]
    long = [f"{p}_count" for _, p in features.long if f"{p}_count" in present]
    clinical = [c for c in clinical_columns(features) if c in present]
    return df.withColumns({
        "available_vital_count": count_where(f"`{c}` > 0" for c in wide),
        "available_lab_count": count_where(f"`{c}` > 0" for c in long),
        "missing_feature_count": count_where(f"`{c}` is null" for c in clinical),
    })


def assemble(base: DataFrame, wide: DataFrame, long: DataFrame, key: str, features: Features) -> DataFrame:
    """One feature row per entity of ``base``; absent counts become 0, values stay null."""
    joined = base.join(wide, key, "left").join(long, key, "left")
    counts = [c for c in count_columns(features) if c in joined.columns]
    return availability(joined.fillna(0, subset=counts), features)


def full_join_summaries(frames: list[DataFrame], key: str) -> DataFrame:
    """Full outer join of per-entity frames on one coalesced key."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.join(frame, key, "full")
    return out
