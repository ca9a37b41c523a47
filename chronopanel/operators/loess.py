"""Local regression, and seasonal-trend decomposition by it (Cleveland et al., 1990).

Rows are taken as equally spaced. A value is smoothed by a straight line through its nearest rows, weighted by the tricube
of their distance; at the ends of a series the window stays whole and only reaches inward. Blocks carry as many rows of their
neighbours as one pass of the inner loop can look back on, so a pass is one exchange whatever a series' length; only the median of
absolute remainders, which sets the robustness weights, is one number per series. Series of one block run in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.operators.quantiles import exact_quantiles
from chronopanel.panel import Panel, PanelError, missing_as_null, need_columns
from chronopanel.plans.units import BLOCK, HALO, ROW, attach, row_blocks, row_index
from chronopanel.session import materialize

CELLS = 1 << 21


def smooth(y: np.ndarray, weight: np.ndarray, first: int, n: int, q: int, at: np.ndarray) -> np.ndarray:
    """The local line through ``q`` rows at the places ``at``. ``y`` holds rows first, first + 1, .. of a series of n rows."""
    width = min(q, n, len(y))
    low = np.clip(at - (q - 1) // 2, 0, max(n - width, 0))
    low = np.clip(low, first, first + len(y) - width)
    out = np.empty(len(at))
    step = max(1, CELLS // width)
    for k in range(0, len(at), step):
        x, lo = at[k : k + step].astype(float), low[k : k + step]
        place = lo[:, None] + np.arange(width)
        far = np.maximum(x - lo, lo + width - 1 - x) + max(q - n, 0) // 2
        r = np.abs(place - x[:, None])
        with np.errstate(divide="ignore", invalid="ignore"):
            w = np.where(r <= 0.001 * far[:, None], 1.0, np.where(r <= 0.999 * far[:, None], (1 - (r / far[:, None]) ** 3) ** 3, 0.0))
            w = w * weight[place - first]
            total = w.sum(axis=1)
            w = w / total[:, None]
            mean = (w * place).sum(axis=1)
            spread = (w * (place - mean[:, None]) ** 2).sum(axis=1)
            tilt = np.where(np.sqrt(spread) > 0.001 * max(n - 1, 1), (x - mean) / spread, 0.0)
            w = w * (1 + tilt[:, None] * (place - mean[:, None]))
            value = (w * y[place - first]).sum(axis=1)
        # Where nothing has weight, the value itself.
        own = np.clip(at[k : k + step] - first, 0, len(y) - 1)
        out[k : k + step] = np.where(total > 0, value, y[own])
    return out


def _mean(v: np.ndarray, k: int) -> np.ndarray:
    s = np.cumsum(np.concatenate(([0.0], v)))
    return (s[k:] - s[:-k]) / k


@dataclass(frozen=True)
class Stl:
    """Window sizes in rows (for ``seasonal``: in periods), all odd. ``outer`` robustness rounds of ``inner`` passes each."""

    period: int = 24
    seasonal: int = 7
    trend: int | None = None
    low_pass: int | None = None
    inner: int = 2
    outer: int = 15

    def __post_init__(self) -> None:
        if self.period < 2 or any(v is not None and (v < 3 or v % 2 == 0) for v in (self.seasonal, self.trend, self.low_pass)):
            raise PanelError("a period of 2 or more and odd windows of 3 or more are needed")

    @property
    def windows(self) -> tuple[int, int]:
        trend = self.trend or int(np.ceil(1.5 * self.period / (1 - 1.5 / self.seasonal))) | 1
        return trend, self.low_pass or (self.period + 1) | 1

    @property
    def reach(self) -> int:
        """Rows that all inner passes of a round look back or ahead on."""
        trend, low = self.windows
        return self.inner * ((self.seasonal - 1) * self.period + self.period + 1 + low - 1 + trend - 1)

    def round(self, y: np.ndarray, trend: np.ndarray, weight: np.ndarray, seen: np.ndarray, first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(seasonal, trend) after one round of inner passes. ``weight``: robustness, ``seen``: 0 where nothing was observed."""
        p, m = self.period, len(y)
        q_trend, q_low = self.windows
        use, at, season = weight * seen, first + np.arange(m), np.zeros(m)
        for _ in range(self.inner):
            cycle = np.zeros(m + 2 * p)
            free = y - trend
            for phase in range(min(p, m)):
                part = slice((phase - first) % p, None, p)
                k = at[part] // p
                if not len(k):
                    continue
                of = np.concatenate(([k[0] - 1], k, [k[-1] + 1]))
                whole = (n - 1 - at[part][0] % p) // p + 1
                cycle[(phase - first) % p :: p][: len(of)] = smooth(free[part], use[part], k[0], whole, self.seasonal, of)
            low = smooth(_mean(_mean(_mean(cycle, p), p), 3), np.ones(m), first, n, q_low, at)
            season = cycle[p : p + m] - low
            trend = smooth(y - season, use, first, n, q_trend, at)
        return season, trend

    def robustness(self, rest: np.ndarray, median: float) -> np.ndarray:
        h, r = 6 * median, np.abs(rest)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(r <= 0.001 * h, 1.0, np.where(r <= 0.999 * h, (1 - (r / h) ** 2) ** 2, 0.0))


def loess(df: DataFrame, panel: Panel, value: str, window: int) -> DataFrame:
    """Add ``smooth``: the local line through the ``window`` nearest rows (odd). Missing rows have no weight but a value."""
    if window < 3 or window % 2 == 0:
        raise PanelError("the window must be odd and 3 at least")
    keys, ts = list(panel.keys), panel.ts
    src = _placed(df, panel, value)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ROW)
        seen = pdf["__y"].notna().to_numpy()
        got = smooth(pdf["__y"].fillna(0.0).to_numpy(), seen.astype(float), int(pdf[ROW].iloc[0]), int(pdf["__n"].iloc[0]), window, pdf[ROW].to_numpy())
        return pdf.assign(smooth=got)[~pdf[HALO]][[*keys, ts, "__y", "smooth"]]

    types = dict(src.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in (*keys, ts)) + ", __y double, smooth double"
    blocks = row_blocks(src, panel, back=window, ahead=window, indexed=True)
    return blocks.groupBy(*keys, BLOCK).applyInPandas(run, schema).withColumnRenamed("__y", value)


def _placed(df: DataFrame, panel: Panel, value: str) -> DataFrame:
    """keys, time, __y, the row's place and the series' number of rows; stored."""
    need_columns(df, [*panel.keys, panel.ts, value])
    slim = missing_as_null(df.select(*panel.keys, panel.ts, F.col(value).cast("double").alias("__y")), ["__y"])
    placed = materialize(row_index(slim, panel))
    return attach(placed, panel, placed.groupBy(*panel.keys).agg(F.count(F.lit(1)).alias("__n")))


def decompose_stl(df: DataFrame, panel: Panel, value: str, how: Stl = Stl()) -> DataFrame:
    """keys, time, value, trend, seasonal, remainder, robustness (the last weight of the row).

    Rows without a value have no weight; their trend and season are estimated, their remainder is null. A series
    needs two periods; shorter ones come out with nulls.
    """
    keys, ts = list(panel.keys), panel.ts
    src = _placed(df, panel, value)
    types = dict(src.dtypes)
    head = ", ".join(f"`{k}` {types[k]}" for k in (*keys, ts)) + ", __y double"
    parts, out = ["trend", "seasonal", "robustness"], [*keys, ts, "__y"]
    schema = head + ", trend double, seasonal double, robustness double"
    several = src.filter(F.col("__n") > panel.unit_rows).limit(1).count()
    if not several:
        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(ROW)
            n, seen = len(pdf), pdf["__y"].notna().to_numpy()
            if n < 2 * how.period:
                return pdf.assign(**{c: np.nan for c in parts})[[*out, *parts]]
            y, trend, weight = pdf["__y"].fillna(0.0).to_numpy(), np.zeros(n), np.ones(n)
            for k in range(how.outer + 1):
                season, trend = how.round(y, trend, weight, seen.astype(float), 0, n)
                rest = y - season - trend
                if k < how.outer and seen.any():
                    weight = how.robustness(rest, float(np.median(np.abs(rest[seen]))))
            return pdf.assign(trend=trend, seasonal=season, robustness=weight)[[*out, *parts]]

        found = src.groupBy(*keys).applyInPandas(whole, schema)
    else:
        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(ROW)
            y, seen = pdf["__y"].fillna(0.0).to_numpy(), pdf["__y"].notna().to_numpy().astype(float)
            n = int(pdf["__n"].iloc[0])
            if n < 2 * how.period:
                season, trend = np.full(len(y), np.nan), np.full(len(y), np.nan)
            else:
                season, trend = how.round(y, pdf["trend"].to_numpy(), pdf["robustness"].to_numpy(), seen, int(pdf[ROW].iloc[0]), n)
            return pdf.assign(trend=trend, seasonal=season)[~pdf[HALO]][[*out, ROW, "__n", *parts]]

        state = src.withColumns({"trend": F.lit(0.0), "seasonal": F.lit(0.0), "robustness": F.lit(1.0)})
        for k in range(how.outer + 1):
            blocks = row_blocks(state.select(*out, ROW, "__n", *parts), panel, back=how.reach, ahead=how.reach, indexed=True)
            state = materialize(blocks.groupBy(*keys, BLOCK).applyInPandas(one, f"{head}, {ROW} bigint, __n bigint, trend double, seasonal double, robustness double"))
            if k < how.outer:
                rest = F.abs(F.col("__y") - F.col("seasonal") - F.col("trend"))
                median = exact_quantiles(state.withColumn("__r", rest), keys, "__r", [0.5]).select(*keys, (F.col("quantile") * 6).alias("__h"))
                # Series without any value have no median and keep their weights.
                h, r = F.col("__h"), F.coalesce(rest, F.lit(0.0))
                weight = F.when(h.isNull(), F.col("robustness")).when(r <= 0.001 * h, 1.0).when(r <= 0.999 * h, F.pow(1 - F.pow(r / h, 2), 2)).otherwise(0.0)
                state = attach(state, panel, state.select(*keys).distinct().join(median, keys, "left")).withColumn("robustness", weight).drop("__h")
        found = state.select(*out, *parts)
    rest = F.col("__y") - F.col("trend") - F.col("seasonal")
    return missing_as_null(found, parts).select(*keys, ts, F.col("__y").alias(value), "trend", "seasonal", rest.alias("remainder"),
                                               F.when(F.col("__y").isNotNull() & F.col("trend").isNotNull(), F.col("robustness")).alias("robustness"))
