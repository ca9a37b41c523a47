"""The panel description that every operator receives."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The allowed grid steps and bucket aggregations.
STEPS = {"1min": 60, "5min": 300, "15min": 900, "30min": 1800, "1h": 3600, "1D": 86400}
AGGREGATIONS = ("mean", "sum", "median", "first", "last")
FLAGS = ("is_originally_missing", "is_outage_gap")


class PanelError(ValueError):
    """Raised when a frame or a parameter does not fit the requested operator."""


def step_seconds(freq: str) -> int:
    if freq not in STEPS:
        raise PanelError(f"unknown frequency {freq!r}; use one of {sorted(STEPS)}")
    return STEPS[freq]


@dataclass(frozen=True)
class Panel:
    """Names the series keys and the time column, and sizes the units of work.

    ``freq`` is the grid step (for raw observations, the usual spacing).
    ``unit_rows`` bounds the rows one window task sorts: a series longer than
    this is cut into pieces, so no series is ever handled by a single task.
    Keys and timestamps must not be null, and a timestamp occurs once per series.
    """

    keys: tuple[str, ...] = ("series_id",)
    ts: str = "ts"
    freq: str = "1h"
    unit_rows: int = 8192

    def __post_init__(self) -> None:
        object.__setattr__(self, "keys", tuple(self.keys))
        step_seconds(self.freq)
        if self.unit_rows < 1:
            raise PanelError("unit_rows must be positive")

    @property
    def step(self) -> int:
        return STEPS[self.freq]

    @property
    def chunk_seconds(self) -> int:
        return self.step * self.unit_rows

    def at(self, freq: str) -> "Panel":
        return replace(self, freq=freq)

    def seconds(self) -> Column:
        """Whole seconds of the time column since the epoch (session zone UTC)."""
        return F.unix_seconds(F.col(self.ts).cast("timestamp"))

    def measures_of(self, df: DataFrame) -> list[str]:
        """Numeric columns that are neither keys nor flags."""
        skip = {*self.keys, self.ts, *FLAGS}
        numeric = ("double", "float", "int", "bigint", "smallint", "tinyint")
        return [n for n, t in df.dtypes if n not in skip and (t in numeric or t.startswith("decimal"))]


def missing_as_null(df: DataFrame, columns) -> DataFrame:
    """NaN and null are both missing in a panel; null is what the operators look for."""
    types = dict(df.dtypes)
    nan = {c: F.when(~F.isnan(c), F.col(c)) for c in columns if types.get(c) in ("double", "float")}
    return df.withColumns(nan) if nan else df


def need_columns(df: DataFrame, names) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise PanelError(f"missing columns {missing}; found {sorted(df.columns)}")
