"""Row-wise cleaning: labels, ages, time windows and plausibility masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortmill.config import Bound, ObservationWindow, Outcome, bounds_frame
from cohortmill.functions.columns import is_missing, lenient_double, outside


def known_outcome(outcome: Outcome) -> Column:
    """True for the two recorded outcomes; false (never null) for anything else."""
    return F.coalesce(F.col(outcome.column).isin(outcome.negative, outcome.positive), F.lit(False))


def label_column(outcome: Outcome) -> Column:
    return (F.when(F.col(outcome.column) == outcome.positive, 1)
            .when(F.col(outcome.column) == outcome.negative, 0).cast("int"))


def encode_outcome(df: DataFrame, outcome: Outcome) -> DataFrame:
    """Keep rows with a recorded outcome and add the 0/1 label."""
    return df.where(known_outcome(outcome)).withColumn(outcome.label, label_column(outcome))


def harmonize_age(df: DataFrame, column: str, capped_text: str = "> 89", capped_value: float = 90.0,
                  number: str = "age_numeric", flag: str = "age_gt89") -> DataFrame:
    """Numeric age and a flag for the capped text; missing stays null in both."""
    capped, missing = F.col(column) == capped_text, is_missing(df, column)
    return df.withColumns({
        flag: F.when(capped, 1).when(~missing, 0).cast("int"),
        number: F.when(capped, F.lit(float(capped_value))).when(~missing, lenient_double(column)),
    })


def time_flags(df: DataFrame, offset: str, window: ObservationWindow = ObservationWindow()) -> DataFrame:
    """Flags before, inside and after the window; drops no row."""
    at = F.col(offset)
    return df.withColumns({
        "pre_icu": at < window.start,
        "first_24h": at.between(window.start, window.end),
        "post_24h": at > window.end,
    })


def in_window(df: DataFrame, offset: str, window: ObservationWindow = ObservationWindow()) -> DataFrame:
    return df.where(F.col(offset).between(window.start, window.end))


def mask_wide(df: DataFrame, bounds: tuple[Bound, ...]) -> DataFrame:
    """Null out values outside their bounds, one projection for all columns."""
    present = [b for b in bounds if b.name in df.columns]
    return df.withColumns({
        b.name: F.when(lenient_double(b.name).between(b.low, b.high), lenient_double(b.name))
        for b in present})


def with_bounds(df: DataFrame, name: str, bounds: tuple[Bound, ...], how: str = "left") -> DataFrame:
    """Add ``low`` and ``high`` of the row's measurement name; null where there is none.

    The bounds are configuration, so their table is always small enough to broadcast.
    """
    table = F.broadcast(bounds_frame(df.sparkSession, bounds))
    return df.join(table, F.col(name) == F.col("bound_name"), how).drop("bound_name")


def mask_long(df: DataFrame, name: str, value: str, bounds: tuple[Bound, ...],
              output: str = "labresult_num") -> DataFrame:
    """Add the numeric result, nulled outside the bounds of its name.

    A name without bounds passes through.
    """
    number = lenient_double(value)
    bad = F.coalesce(outside(number, F.col("low"), F.col("high")), F.lit(False))
    return with_bounds(df, name, bounds).withColumn(output, F.when(~bad, number)).drop("low", "high")


def fill_unknown(df: DataFrame, columns: tuple[str, ...], word: str = "Unknown") -> DataFrame:
    """Null or blank categories become one explicit category."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: F.when(is_missing(df, c), word).otherwise(F.col(c)) for c in present})


def keep_present(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[c for c in columns if c in df.columns])


def lenient_columns(df: DataFrame, columns: list[str], suffix: str = "_num") -> DataFrame:
    return df.withColumns({f"{c}{suffix}": lenient_double(c) for c in columns if c in df.columns})
