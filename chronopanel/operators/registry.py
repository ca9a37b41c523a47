"""Which columns may feed a model: a registry of names and prefixes, and its guard."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from chronopanel.functions.calendar import CALENDAR_NAMES, CYCLICAL_NAMES
from chronopanel.panel import FLAGS, PanelError

CATEGORIES = ("raw", "calendar", "lag", "rolling", "cyclical", "external", "indicator")
ROLLING_STATS = ("mean", "std", "min", "max")


class LeakageError(PanelError):
    """An unsafe or unregistered column reached the feature matrix."""


@dataclass(frozen=True)
class FeatureSpec:
    """A column name, or a prefix ending in ``*``, and whether a model may use it."""

    pattern: str
    category: str
    safe: bool
    description: str = ""

    def matches(self, name: str) -> bool:
        if self.pattern.endswith("*"):
            return name.startswith(self.pattern[:-1])
        return name == self.pattern


@dataclass
class Registry:
    specs: list[FeatureSpec] = field(default_factory=list)

    def register(self, pattern: str, category: str, safe: bool, description: str = "") -> "Registry":
        if category not in CATEGORIES:
            raise PanelError(f"unknown category {category!r}")
        self.specs.append(FeatureSpec(pattern, category, safe, description))
        return self

    def find(self, name: str) -> FeatureSpec | None:
        """Exact names win over prefixes."""
        hits = [s for s in self.specs if s.matches(name)]
        return min(hits, key=lambda s: s.pattern.endswith("*"), default=None)

    def is_safe(self, name: str) -> bool | None:
        spec = self.find(name)
        return None if spec is None else spec.safe

    def split(self, names: Iterable[str]) -> tuple[list[str], list[str], list[str]]:
        """(safe, unsafe, unregistered) names, in their order."""
        out: dict[bool | None, list[str]] = {True: [], False: [], None: []}
        for n in names:
            out[self.is_safe(n)].append(n)
        return out[True], out[False], out[None]

    def check(self, features: Sequence[str], strict: bool = True) -> list[str]:
        """The unsafe features; raises in strict mode on unsafe or unregistered ones."""
        _, unsafe, unknown = self.split(features)
        if strict and (unsafe or unknown):
            parts = [f"unsafe: {unsafe}"] if unsafe else []
            parts += [f"not registered: {unknown}"] if unknown else []
            raise LeakageError("features refused; " + "; ".join(parts))
        return unsafe

    def catalogue(self, spark: SparkSession) -> DataFrame:
        rows = [(s.pattern, s.category, s.safe, s.description) for s in self.specs]
        return spark.createDataFrame(rows, "pattern string, category string, safe boolean, description string")


def default_registry(target: str, unsafe: Iterable[str] = ()) -> Registry:
    """Registry of everything `build_features` makes, plus same-time columns to refuse."""
    r = Registry()
    r.register(target, "raw", True, "target; safe only through its past")
    for name in unsafe:
        r.register(name, "raw", False, "measured at the same time as the target")
    for name in CALENDAR_NAMES:
        r.register(name, "calendar", True, "known from the timestamp")
    for name in CYCLICAL_NAMES:
        r.register(name, "cyclical", True, "known from the timestamp")
    r.register(f"{target}_lag_*", "lag", True, "earlier target value")
    for stat in ROLLING_STATS:
        r.register(f"{target}_roll_{stat}_*", "rolling", True, f"{stat} of earlier target values")
    r.register("is_french_holiday", "external", True, "public holiday")
    r.register("is_french_school_vacation", "external", True, "school vacation")
    for name in FLAGS:
        r.register(name, "indicator", True, "known missingness")
    return r


# Same-time columns of the household power panel.
POWER_TARGET = "Global_active_power"
POWER_UNSAFE = (
    "Global_intensity", "Voltage", "Global_reactive_power", "Sub_metering_1", "Sub_metering_2", "Sub_metering_3",
)
