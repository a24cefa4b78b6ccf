"""Cohort rules: index event, landmark, restriction of measurements, attrition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortmill.config import ObservationWindow, Outcome, Roles
from cohortmill.functions.columns import count_true, percent
from cohortmill.operators.clean import in_window, known_outcome


def index_by_visit(df: DataFrame, visit: str) -> DataFrame:
    """Stays whose visit number is 1."""
    return df.where(F.col(visit) == 1)


def index_by_order(df: DataFrame, encounter: str, order: list[str]) -> DataFrame:
    """First stay of every encounter in ``order``.

    An aggregation rather than a window: the smallest row of an encounter is
    found before the shuffle, so a huge encounter costs one row per task.
    """
    rest = [c for c in df.columns if c not in order]
    first = df.groupBy(F.col(encounter).alias("__encounter")).agg(
        F.min(F.struct(*order, *rest)).alias("__first"))
    return first.select(*[F.col(f"__first.{c}").alias(c) for c in df.columns])


def label_is(label: str, value: int) -> Column:
    return F.col(label) == value


def outcome_report(df: DataFrame, outcome: Outcome) -> DataFrame:
    """Kept and dropped rows of the outcome rule; kept + dropped = all."""
    known = known_outcome(outcome)
    n = F.count(F.lit(1))
    return df.agg(
        n.alias("initial_stays"),
        count_true(~known).alias("excluded_unknown"),
        percent(F.count_if(~known), n).alias("excluded_pct"),
        count_true(known).alias("retained"),
        count_true(F.col(outcome.column) == outcome.negative).alias("alive"),
        count_true(F.col(outcome.column) == outcome.positive).alias("expired"),
        percent(F.count_if(F.col(outcome.column) == outcome.positive), F.count_if(known)).alias("prevalence_pct"),
    )


def index_report(df: DataFrame, kept: Column, removed: Column, label: str, strategy: str) -> DataFrame:
    """Counts and outcome rates on both sides of the index rule.

    Rows that are on neither side (null visit number) are counted as unknown.
    """
    positive = label_is(label, 1)
    n, n_kept, n_removed = F.count(F.lit(1)), F.count_if(kept), F.count_if(removed)
    return df.agg(
        F.lit(strategy).alias("strategy"),
        n.cast("bigint").alias("initial_stays"),
        n_removed.alias("removed"), percent(n_removed, n).alias("removed_pct"),
        n_kept.alias("retained"),
        (n - n_kept - n_removed).alias("unknown"),
        F.count_if(kept & positive).alias("retained_expired"),
        percent(F.count_if(kept & positive), n_kept).alias("retained_mortality_pct"),
        F.count_if(removed & positive).alias("removed_expired"),
        percent(F.count_if(removed & positive), n_removed).alias("removed_mortality_pct"),
    )


def index_report_by_visit(df: DataFrame, visit: str, label: str) -> DataFrame:
    return index_report(df, F.col(visit) == 1, F.col(visit) > 1, label, "visit_number")


def index_report_by_order(df: DataFrame, encounter: str, order: list[str], label: str) -> DataFrame:
    """Report of the first-per-encounter rule from per-encounter partial results.

    Only counts and the label of the first row are aggregated; the removed side
    is the difference, so no anti join is needed.
    """
    per = df.groupBy(encounter).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(label_is(label, 1)).alias("pos"),
        F.min(F.struct(*order, label)).alias("first"))
    kept_pos = F.count_if(F.col(f"first.{label}") == 1)
    n, kept = F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))
    removed, removed_pos = n - kept, F.coalesce(F.sum("pos"), F.lit(0)) - kept_pos
    return per.agg(
        F.lit("first_per_encounter").alias("strategy"),
        n.alias("initial_stays"), removed.alias("removed"), percent(removed, n).alias("removed_pct"),
        kept.alias("retained"), F.lit(0).cast("bigint").alias("unknown"),
        kept_pos.alias("retained_expired"), percent(kept_pos, kept).alias("retained_mortality_pct"),
        removed_pos.alias("removed_expired"), percent(removed_pos, removed).alias("removed_mortality_pct"),
    )


def landmark(df: DataFrame, duration: str, minutes: int) -> DataFrame:
    """Entities still present at the landmark."""
    return df.where(F.col(duration) >= minutes)


def landmark_report(df: DataFrame, roles: Roles, minutes: int) -> DataFrame:
    label = roles.outcome.label
    long_enough, short = F.col(roles.duration) >= minutes, F.col(roles.duration) < minutes
    n, n_short, n_long = F.count(F.lit(1)), F.count_if(short), F.count_if(long_enough)
    dead, alive = label_is(label, 1), label_is(label, 0)
    return df.agg(
        F.lit(minutes).cast("bigint").alias("landmark_minutes"),
        n.alias("initial_stays"),
        n_short.alias("short_stays"), percent(n_short, n).alias("short_pct"),
        F.count_if(short & dead).alias("short_expired"), F.count_if(short & alive).alias("short_alive"),
        percent(F.count_if(short & dead), n_short).alias("short_mortality_pct"),
        F.count_if(short & (F.col(roles.interim_status) == roles.outcome.positive)).alias("short_unit_expired"),
        n_long.alias("eligible"), percent(n_long, n).alias("eligible_pct"),
        (n - n_short - n_long).alias("unknown"),
        F.count_if(long_enough & dead).alias("eligible_expired"),
        F.count_if(long_enough & alive).alias("eligible_alive"),
        percent(F.count_if(long_enough & dead), n_long).alias("eligible_mortality_pct"),
    )


def attrition_flow(df: DataFrame, roles: Roles, minutes: int, first_per_encounter: bool = False) -> DataFrame:
    """Long table (step, n, positives, negatives, removed, pct) of either index rule.

    Index stays have visit number 1 or, with ``first_per_encounter``, come first
    among the stays of their encounter that have a known outcome. Each row is given the last step it survives; the steps are then nested
    counts, so no step scans the table again.
    """
    out = roles.outcome
    index = F.coalesce(F.col(roles.visit) == 1, F.lit(False))
    if first_per_encounter:
        first = df.where(known_outcome(out)).groupBy(roles.encounter).agg(
            F.min(F.struct(*roles.index_order)).alias("f")).select(F.col(f"f.{roles.entity}").alias(roles.entity))
        df = df.join(first.withColumn("__index", F.lit(True)), roles.entity, "left")
        index = F.coalesce(F.col("__index"), F.lit(False))
    survived = (F.when(~known_outcome(out), 0)
                .when(~index, 1)
                .when(~F.coalesce(F.col(roles.duration) >= minutes, F.lit(False)), 2).otherwise(3))
    steps = ["raw", "known_outcome", "index_stay", "landmark", "final_cohort"]
    depth = df.select(survived.alias("depth"), F.col(out.column).alias("s")).agg(*[
        expr for i, step in enumerate(steps) for expr in (
            F.count_if(F.col("depth") >= min(i, 3)).alias(f"n{i}"),
            F.count_if((F.col("depth") >= min(i, 3)) & (F.col("s") == out.positive)).alias(f"p{i}"),
            F.count_if((F.col("depth") >= min(i, 3)) & (F.col("s") == out.negative)).alias(f"a{i}"))])
    rows = [F.struct(
        F.lit(i).cast("int").alias("step_no"), F.lit(step).alias("step"), F.col(f"n{i}").alias("n"),
        F.col(f"p{i}").alias("positives"), F.col(f"a{i}").alias("negatives"),
        (F.col(f"n{max(i - 1, 0)}") - F.col(f"n{i}")).alias("removed"),
        percent(F.col(f"p{i}"), F.col(f"p{i}") + F.col(f"a{i}")).alias("prevalence_pct"))
        for i, step in enumerate(steps)]
    return depth.select(F.inline(F.array(*rows)))


def restrict_to(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in ``ids``.

    A key list that was written to files has a known size in bytes, by which
    Spark decides: a small one is broadcast and filters where the rows are read,
    a larger one is a shuffled semi join, whose hot keys adaptive execution splits.
    """
    return df.join(ids.select(key), key, "left_semi")


def extract_window(df: DataFrame, ids: DataFrame, key: str, offset: str,
                   window: ObservationWindow = ObservationWindow()) -> DataFrame:
    """Measurements of the cohort inside the window; the window filter reaches the scan."""
    return restrict_to(in_window(df, offset, window), ids, key)


def assert_inside(df: DataFrame, offset: str, window: ObservationWindow = ObservationWindow()) -> DataFrame:
    """Raise if any row lies outside the window (one counting job), else return df."""
    before, after = df.agg(F.count_if(F.col(offset) < window.start), F.count_if(F.col(offset) > window.end)).first()
    if before or after:
        raise ValueError(f"{before} rows before and {after} rows after the window in {offset}")
    return df


def coverage(df: DataFrame, key: str, cohort_size: DataFrame, name: str) -> DataFrame:
    """Records, distinct entities and their share of the cohort (a 1-row table ``n``)."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    seen = per_key.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("records"),
                       F.count(F.lit(1)).alias("entities"))
    return seen.join(F.broadcast(cohort_size)).select(
        F.lit(name).alias("table_name"), "records", "entities",
        percent(F.col("entities"), F.col("n")).alias("coverage_pct"))
