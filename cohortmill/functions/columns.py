"""Column expressions shared by the operators. All are JVM-side built-ins."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, or the empty string for string columns."""
    column = F.col(name)
    if isinstance(df.schema[name].dataType, T.StringType):
        return column.isNull() | (column == "")
    return column.isNull()


def lenient_double(column: Column | str) -> Column:
    """Cast to double; text that is no number becomes null instead of failing."""
    column = F.col(column) if isinstance(column, str) else column
    return column.try_cast("double")


def share(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, 0 where the denominator is 0."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def percent(numerator: Column, denominator: Column) -> Column:
    return share(numerator * 100.0, denominator)


def clip(column: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), column))


def outside(column: Column, low: Column | float, high: Column | float) -> Column:
    """Outside the inclusive interval; null for a null value or null bounds."""
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return (column < low) | (column > high)


def count_true(condition: Column) -> Column:
    return F.count_if(condition).cast("bigint")


def add_all(columns: Iterable[Column]) -> Column:
    """Row-wise sum of columns (0 when there is none)."""
    total = None
    for column in columns:
        total = column if total is None else total + column
    return F.lit(0) if total is None else total


def sql_text(value: str) -> str:
    """A string literal in Spark SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def count_where(conditions: Iterable[str]) -> Column:
    """How many of the SQL conditions hold in a row, as one parsed expression."""
    text = " + ".join(f"cast(coalesce({c}, false) as int)" for c in conditions)
    return F.expr(text) if text else F.lit(0)


def as_int(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def hash_digits(*parts: Column | str) -> Column:
    """The eight hex digits behind ``unit_hash``, which order as its numbers do."""
    text = F.concat_ws(":", *[p if isinstance(p, Column) else F.col(p) for p in parts])
    return F.substring(F.md5(text), 1, 8)


def unit_hash(*parts: Column | str) -> Column:
    """A number in [0, 1) that depends only on the text of ``parts``.

    32 bits of md5: the same value on every engine, partitioning and retry.
    """
    return F.conv(hash_digits(*parts), 16, 10).cast("double") / F.lit(4294967296.0)


def sigmoid(column: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-column))


def band(column: Column, low: Column | float, high: Column | float,
         labels: tuple[str, str, str] = ("LOW", "MODERATE", "HIGH")) -> Column:
    """<= low, then >= high, else the middle label; the low test comes first."""
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.when(column <= low, labels[0]).when(column >= high, labels[2]).otherwise(labels[1])


def contains_any(column: Column, keywords: Iterable[str]) -> Column:
    """Lower-cased text holds one of the keywords; false for null."""
    tests = [F.contains(F.lower(column.cast("string")), F.lit(word)) for word in keywords]
    out = tests[0]
    for test in tests[1:]:
        out = out | test
    return F.coalesce(out, F.lit(False))


def poisson_one_cdf(limit: int = 12) -> list[float]:
    """Cumulative probabilities of a Poisson(1) count, 0 .. limit."""
    total, out = 0.0, []
    for k in range(limit + 1):
        total += math.exp(-1.0) / math.factorial(k)
        out.append(total)
    return out


def poisson_one(digits: Column, limit: int = 12) -> Column:
    """Poisson(1) count by inverse distribution of the number that ``unit_hash`` makes of ``hash_digits``.

    The digits are compared as text, which spares every row the number.
    """
    out = None
    for k, edge in enumerate(poisson_one_cdf(limit)):
        least = math.ceil(edge * 4294967296.0)
        # Above all digits where every number is below the edge.
        below = digits < (f"{least:08x}" if least < 1 << 32 else "g")
        out = F.when(below, k) if out is None else out.when(below, k)
    return out.otherwise(limit + 1)
