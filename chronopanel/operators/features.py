"""Past-only features: lags, rolling statistics, the feature matrix, sequence samples.

All features of a panel are built over one window definition, so the whole
matrix costs one exchange for positions and one for blocks, whatever its width.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from chronopanel.functions.calendar import calendar_columns, cyclical_columns, holiday_flag
from chronopanel.operators.registry import Registry, default_registry
from chronopanel.panel import Panel, PanelError, missing_as_null, need_columns
from chronopanel.plans.folds import assign_folds
from chronopanel.plans.units import BLOCK, ROW, attach, over_blocks, over_spans

# The default feature set, and the wider lag set of the earlier variant.
LAGS, WINDOWS = (1, 24, 168), (3, 24, 168)
WIDE_LAGS, WIDE_WINDOWS = (1, 2, 3, 24, 48, 168), (3, 6, 12, 24, 48, 168)
# Windows longer than this are put together from up to MAX_PARTS shorter ones where possible.
DIRECT_ROWS, MAX_PARTS = 32, 24
STATS = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


def lag_columns(target: str, lags: Sequence[int], w: WindowSpec, time_step: int | None = None) -> list[Column]:
    """``<target>_lag_<n>h``; by row, or by time when ``time_step`` seconds is given."""
    if any(n < 1 for n in lags):
        raise PanelError("lags must be at least 1")
    if time_step is None:
        return [F.lag(target, n).over(w).alias(f"{target}_lag_{n}h") for n in lags]
    at = lambda n: w.rangeBetween(-n * time_step, -n * time_step)
    return [F.max(target).over(at(n)).alias(f"{target}_lag_{n}h") for n in lags]


def rolling_columns(
    target: str,
    windows: Sequence[int],
    w: WindowSpec,
    stats: Sequence[str] = tuple(STATS),
    time_step: int | None = None,
) -> list[Column]:
    """``<target>_roll_<stat>_<n>h`` over the n rows before the current one.

    Null unless all n values are present.
    """
    out = []
    for n in windows:
        frame = w.rowsBetween(-n, -1) if time_step is None else w.rangeBetween(-n * time_step, -time_step)
        full = F.count(target).over(frame) == n
        for s in stats:
            agg = F.percentile(target, F.lit(0.5)) if s == "median" else STATS[s](target)
            out.append(F.when(full, agg.over(frame)).alias(f"{target}_roll_{s}_{n}h"))
    return out


def _base_window(n: int, windows: Sequence[int]) -> int | None:
    """The window that n can be put together from, if sliding over n rows would be slow."""
    fits = [b for b in windows if b < n and n % b == 0 and n // b <= MAX_PARTS]
    return max(fits, default=None) if n > DIRECT_ROWS else None


def add_rolling(
    blocks: DataFrame, target: str, windows: Sequence[int], w: WindowSpec, stats: Sequence[str] = tuple(STATS)
) -> DataFrame:
    """`rolling_columns` over rows, with long windows put together from shorter ones.

    Sliding over n rows costs n steps per row. A window of k times b rows is
    the union of k windows of b rows, each already computed at an earlier row,
    so it costs k steps: means and squared deviations are merged without
    cancellation, extremes by comparison. All levels share one sort.
    """
    name = lambda s, n: f"{target}_roll_{s}_{n}h"
    composed = {n: _base_window(n, windows) for n in windows}
    direct = [n for n in windows if composed[n] is None]
    # Merging deviations needs the means as well.
    need = list(stats) if "std" not in stats or "mean" in stats else [*stats, "mean"]
    out = blocks.select("*", *rolling_columns(target, direct, w, need))
    for n in sorted(n for n in windows if composed[n]):
        b = composed[n]
        k = n // b
        # One lag of a struct per part: the window operator walks the rows once per lagged column.
        out = out.withColumn("__p0", F.struct(*[F.col(name(s, b)).alias(s) for s in need]))
        out = out.withColumns({f"__p{i}": F.lag("__p0", i * b).over(w) for i in range(1, k)})
        # A part is null when it is not full, which makes these sums null as well.
        of = lambda s, form="{}": " + ".join(form.format(f"__p{i}.{s}") for i in range(k))  # noqa: E731, B023
        listed = lambda s: ", ".join(f"__p{i}.{s}" for i in range(k))  # noqa: E731, B023
        shift = [f"(__p{i}.mean - __p0.mean)" for i in range(1, k)]
        # Deviations within the parts, and of the parts' means from the newest part's mean.
        inner = f"({of('std', '{0} * {0}')}) * {b - 1}"
        between = f"({' + '.join(f'{d} * {d}' for d in shift)} - pow({' + '.join(shift)}, 2) / {k}) * {b}"
        made = {
            "mean": f"({of('mean')}) / {k}",
            "std": f"sqrt(({inner} + {between}) / {n - 1})",
            "min": f"if(({of('min')}) IS NOT NULL, least({listed('min')}), NULL)",
            "max": f"if(({of('max')}) IS NOT NULL, greatest({listed('max')}), NULL)",
        }
        out = out.withColumns({name(s, n): F.expr(made[s]) for s in need})
        out = out.drop(*[f"__p{i}" for i in range(k)])
    return out.select(*blocks.columns, *[name(s, n) for n in windows for s in stats])


def sliding_median(v: np.ndarray, n: int) -> np.ndarray:
    """Median of the n values before each place; NaN unless all are there.

    The window is a sorted list, to which each step adds one value and from which it takes one, so a longer window costs
    only the longer search.
    """
    out, window, missing = np.full(len(v), np.nan), [], 0
    for i, x in enumerate(v.tolist()):
        if i >= n and not missing:
            out[i] = (window[(n - 1) // 2] + window[n // 2]) / 2
        if x == x:
            insort(window, x)
        else:
            missing += 1
        if i >= n:
            old = v[i - n]
            if old == old:
                del window[bisect_left(window, old)]
            else:
                missing -= 1
    return out


def add_medians(blocks: DataFrame, panel: Panel, target: str, windows: Sequence[int]) -> DataFrame:
    """``<target>_roll_median_<n>h`` over the n rows before each; a block is a group of bounded size."""
    names = [f"{target}_roll_median_{n}h" for n in windows]

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(ROW)
        v = rows.column(target).cast(pa.float64()).to_numpy(zero_copy_only=False)
        for name, n in zip(names, windows, strict=True):
            rows = rows.append_column(name, pa.array(sliding_median(v, n), pa.float64(), from_pandas=True))
        return rows

    schema = ", ".join(f"`{c}` {t}" for c, t in [*blocks.dtypes, *[(n, "double") for n in names]])
    return blocks.groupBy(*panel.keys, BLOCK).applyInArrow(run, schema)


def past_features(
    df: DataFrame,
    panel: Panel,
    target: str,
    lags: Sequence[int] = LAGS,
    windows: Sequence[int] = WINDOWS,
    stats: Sequence[str] = tuple(STATS),
    mode: str = "rows",
    extra: Sequence[Column] = (),
    outside_lags: Mapping[str, Sequence[int]] | None = None,
) -> DataFrame:
    """Append lag and rolling columns (and any further expressions).

    ``outside_lags`` names other columns and their lags, as ``<column>_lag_<n>h`` over the same window.
    ``mode="rows"`` counts rows of the frame, ``mode="time"`` counts grid steps.
    """
    if mode not in ("rows", "time"):
        raise PanelError(f"unknown mode {mode!r}")
    if any(n < 2 for n in windows):
        raise PanelError("rolling windows must be at least 2")
    outside = {c: tuple(n) for c, n in (outside_lags or {}).items()}
    need_columns(df, outside)
    reach = max([*lags, *windows, *(n for some in outside.values() for n in some)], default=0)

    def lagged(w: WindowSpec, step: int | None = None) -> list[Column]:
        more = [c for name, some in outside.items() for c in lag_columns(name, some, w, step)]
        return [*lag_columns(target, lags, w, step), *more]

    def by_rows(blocks: DataFrame, w: WindowSpec) -> DataFrame:
        out = blocks.select("*", *extra, *lagged(w))
        before, simple = out.columns, [s for s in stats if s != "median"]
        if simple:
            out = add_rolling(out, target, windows, w, simple)
        if "median" in stats:
            out = add_medians(out, panel, target, windows)
        return out.select(*before, *[f"{target}_roll_{s}_{n}h" for n in windows for s in stats])

    def by_time(blocks: DataFrame, w: WindowSpec) -> DataFrame:
        return blocks.select(
            "*", *extra, *lagged(w, panel.step), *rolling_columns(target, windows, w, stats, panel.step)
        )

    if mode == "rows":
        return over_blocks(df, panel, by_rows, back=reach)
    return over_spans(df, panel, by_time, back_seconds=reach * panel.step)


def build_features(
    df: DataFrame,
    panel: Panel,
    target: str,
    lags: Sequence[int] = LAGS,
    windows: Sequence[int] = WINDOWS,
    stats: Sequence[str] = tuple(STATS),
    calendar: bool = True,
    cyclical: bool = True,
    holidays: bool = True,
    registry: Registry | None = None,
    strict: bool = True,
    mode: str = "rows",
    drop_incomplete: bool = True,
    outside_lags: Mapping[str, Sequence[int]] | None = None,
) -> DataFrame:
    """The model-ready matrix: keys, time, target, then features.

    Unsafe inputs are dropped and unregistered ones not carried, whatever
    ``strict`` says; ``strict`` refuses unsafe or unregistered outputs. Rows
    with a null target or feature are dropped.
    """
    need_columns(df, [*panel.keys, panel.ts, target])
    registry = registry or default_registry(target)
    others = [c for c in df.columns if c not in {*panel.keys, panel.ts, target}]
    carried, _, _ = registry.split(others)
    extra = [
        *(calendar_columns(panel.ts) if calendar else []),
        *(cyclical_columns(panel.ts) if cyclical else []),
        *([holiday_flag(panel.ts)] if holidays else []),
    ]
    base = missing_as_null(df.select(*panel.keys, panel.ts, target, *carried), [target, *carried])
    out = past_features(base, panel, target, lags, windows, stats, mode, extra, outside_lags)
    features = [c for c in out.columns if c not in {*panel.keys, panel.ts, target}]
    registry.check(features, strict)
    return out.dropna("any", subset=[target, *features]) if drop_incomplete else out


def feature_names(matrix: DataFrame, panel: Panel, target: str) -> list[str]:
    return [c for c in matrix.columns if c not in {*panel.keys, panel.ts, target}]


def retention(full: DataFrame, panel: Panel, target: str) -> DataFrame:
    """Rows before and after dropping incomplete ones, in one pass over the full matrix."""
    names = [target, *feature_names(full, panel, target)]
    complete = F.lit(True)
    for n in names:
        complete = complete & F.col(n).isNotNull()
    return full.groupBy(*panel.keys).agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(complete).alias("rows_after"),
        (F.count_if(complete) * 100.0 / F.count(F.lit(1))).alias("retained_pct"),
    )


def history_slice(df: DataFrame, panel: Panel, start: str, end: str, lookback: str) -> DataFrame:
    """Rows needed to compute features on [start, end]: a window cannot push a time filter down."""
    ts = F.col(panel.ts)
    lo = F.lit(start).cast("timestamp_ntz") - F.expr(f"interval {lookback}")
    return df.filter((ts >= lo) & (ts <= F.lit(end).cast("timestamp_ntz")))


def zscore_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean and population deviation (plus 1e-8) used to normalise sequences."""
    return df.groupBy(*keys).agg(
        F.avg(value).alias("train_mean"), (F.stddev_pop(value) + F.lit(1e-8)).alias("train_std")
    )


def training_stats(df: DataFrame, panel: Panel, value: str, folds: DataFrame, fold: int) -> DataFrame:
    """Mean and deviation of one fold's training rows, for `sequence_samples`: nothing of later rows leaks."""
    one = folds.filter(F.col("fold") == fold)
    train = assign_folds(df.select(*panel.keys, panel.ts, value), panel, one, roles=("train",))
    return zscore_stats(missing_as_null(train, [value]), panel.keys, value)


def sequence_samples(df: DataFrame, panel: Panel, value: str, lookback: int, stats: DataFrame | None = None) -> DataFrame:
    """``lookback`` past normalised values as an array, and the next value.

    Rows without a full history, or without a next value, are dropped. The result is ``lookback`` times
    the input, so consume it directly rather than storing it. Without ``stats`` the whole series is normalised with
    its own mean and deviation; for a backtest pass those of the training rows (`training_stats`).
    """
    df = missing_as_null(df, [value])
    stats = zscore_stats(df, panel.keys, value) if stats is None else stats
    z = ((F.col(value) - F.col("train_mean")) / F.col("train_std")).cast("float")
    src = attach(df.select(*panel.keys, panel.ts, value), panel, stats)
    src = src.select(*panel.keys, panel.ts, z.alias("next_value"), "train_mean", "train_std")

    def windows(blocks: DataFrame, w: WindowSpec) -> DataFrame:
        return blocks.withColumn("history", F.collect_list("next_value").over(w.rowsBetween(-lookback, -1)))

    return over_blocks(src, panel, windows, back=lookback).filter((F.size("history") == lookback) & F.col("next_value").isNotNull())


def denormalise(value: Column) -> Column:
    """Inverse of the sequence normalisation."""
    return value * F.col("train_std") + F.col("train_mean")
