"""Column roles and rules: everything the operators need to know about a data set."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from cohortmill.functions.columns import sql_text


@dataclass(frozen=True)
class Bound:
    """Inclusive plausibility interval of one measurement."""

    name: str
    low: float
    high: float
    source: str = ""


@dataclass(frozen=True)
class Outcome:
    """Text column that is turned into a 0/1 label."""

    column: str
    negative: str
    positive: str
    label: str


@dataclass(frozen=True)
class Roles:
    """Names of the columns that play a role in the entity and measurement tables."""

    entity: str
    encounter: str
    person: str
    outcome: Outcome
    age: str
    visit: str
    duration: str
    interim_status: str
    long_name: str
    long_value: str
    long_offset: str
    long_order: str
    wide_offset: str
    age_capped_text: str = "> 89"
    age_capped_value: float = 90.0
    admit_offset: str = ""

    @property
    def index_order(self) -> list[str]:
        """What decides which stay of an encounter is the first: visit, admission offset if there is one, key."""
        return [self.visit, *([self.admit_offset] if self.admit_offset else []), self.entity]


@dataclass(frozen=True)
class ObservationWindow:
    """Minutes from admission, both ends included."""

    start: int = 0
    end: int = 1440


@dataclass(frozen=True)
class Features:
    """Which columns and names become features."""

    admission: tuple[str, ...]
    unknown_filled: tuple[str, ...]
    wide: tuple[str, ...]
    long: tuple[tuple[str, str], ...]
    identifiers: tuple[str, ...]
    target: str


@dataclass(frozen=True)
class Preset:
    """A complete description of one kind of data set."""

    roles: Roles
    features: Features
    wide_bounds: tuple[Bound, ...]
    long_bounds: tuple[Bound, ...]
    required: dict[str, tuple[str, ...]] = field(default_factory=dict)
    demographics: tuple[str, ...] = ()
    window: ObservationWindow = ObservationWindow()
    landmark: int = 1440


def bounds_frame(spark: SparkSession, bounds: tuple[Bound, ...]) -> DataFrame:
    """Bounds as a local table; its size is that of the configuration, not of the data."""
    if not bounds:
        return spark.sql("select '' as bound_name, 0.0D as low, 0.0D as high where false")
    rows = ", ".join(f"({sql_text(b.name)}, {float(b.low)!r}D, {float(b.high)!r}D)" for b in bounds)
    return spark.sql(f"select * from values {rows} as t(bound_name, low, high)")
