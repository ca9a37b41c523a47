"""Seasonal ARIMA for panels by two-stage least squares (Hannan and Rissanen, 1982).

Stage one fits a long autoregression to the differenced series and takes its
residuals as the innovations; stage two regresses on lagged values and lagged
innovations. Both stages are sums of cross products per (series, fold), so all
series and folds are fitted by two group-bys; only the tiny normal equations
are solved in Python. The seasonal lags enter additively and unconstrained, so
estimates differ from maximum likelihood.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.operators.evaluate import first_n
from chronopanel.panel import Panel, PanelError, need_columns
from chronopanel.plans.folds import assign_folds
from chronopanel.plans.units import ROW, attach, over_blocks, row_index
from chronopanel.session import materialize

RIDGE = 1e-10


@dataclass(frozen=True)
class SeasonalArima:
    order: tuple[int, int, int] = (1, 1, 1)
    seasonal: tuple[int, int, int, int] = (1, 1, 1, 24)
    exog: tuple[str, ...] = ()
    name: str = "seasonal_arima"

    def __post_init__(self) -> None:
        if self.order[1] not in (0, 1) or self.seasonal[1] not in (0, 1):
            raise PanelError("differencing orders must be 0 or 1")
        if self.seasonal[3] < 2:
            raise PanelError("the season must be at least 2 rows")

    def get_hyperparameters(self) -> dict[str, Any]:
        return {"order": self.order, "seasonal": self.seasonal, "exog": list(self.exog)}

    # Lag sets, in rows of the differenced series.
    @property
    def ar(self) -> list[int]:
        return _grid(self.order[0], self.seasonal[0], self.seasonal[3])

    @property
    def ma(self) -> list[int]:
        return _grid(self.order[2], self.seasonal[2], self.seasonal[3])

    @property
    def long_ar(self) -> list[int]:
        s = self.seasonal[3]
        return sorted({1, 2, 3, s - 1, s, s + 1, 2 * s - 1, 2 * s, 2 * s + 1} - {0})

    @property
    def diff(self) -> dict[int, float]:
        """Differencing as weights on lags: w[t] = sum of weight * y[t - lag]."""
        s, out = self.seasonal[3], {0: 1.0}
        for on, lag in ((self.order[1], 1), (self.seasonal[1], s)):
            if on:
                out = _convolve(out, {0: 1.0, lag: -1.0})
        return out

    @property
    def w_lags(self) -> list[int]:
        inner = {0, *self.ar, *self.long_ar}
        return sorted(inner | {j + i for j in self.ma for i in (0, *self.long_ar)})

    @property
    def reach(self) -> int:
        return max(self.w_lags) + max(self.diff)

    # --- fitting ---

    def _w(self, lag: int) -> Column:
        return F.col("__w")[self.w_lags.index(lag)]

    def _innovation(self, lag: int) -> Column:
        """Stage-one residual ``lag`` rows back."""
        e = self._w(lag) - F.col("__phi")[len(self.long_ar)]
        for k, i in enumerate(self.long_ar):
            e = e - F.col("__phi")[k] * self._w(lag + i)
        return e

    def _regressors(self) -> list[Column]:
        x = [F.col("__x")[k] for k in range(len(self.exog))]
        return [self._w(i) for i in self.ar] + [self._innovation(j) for j in self.ma] + x

    def history(self, matrix: DataFrame, panel: Panel, target: str) -> DataFrame:
        """Rows with the differenced value and its lags as an array, and the part of y they leave out."""
        need_columns(matrix, [target, *self.exog])
        weights = self.diff

        def lagged(blocks: DataFrame, w) -> DataFrame:
            def delta(name: str) -> Column:
                return sum((F.lag(name, k).over(w) * c for k, c in weights.items() if k), F.col(name) * 1.0)

            with_w = blocks.withColumns({"__d": delta(target), "__base": F.col(target) - delta(target)})
            at = F.array(*[F.lag("__d", k).over(w) if k else F.col("__d") for k in self.w_lags])
            x = F.array(*[delta(c) for c in self.exog]) if self.exog else F.array().cast("array<double>")
            return with_w.withColumns({"__w": at, "__x": x}).drop("__d")

        slim = matrix.select(*panel.keys, panel.ts, F.col(target).cast("double").alias(target), *self.exog)
        # Both stages and the forecasts walk the rows again: the narrow rows with their
        # positions are stored, the wide lag arrays never are.
        placed = materialize(row_index(slim, panel))
        rows = over_blocks(placed, panel, lagged, back=self.reach, keep_row=True, indexed=True)
        whole = ~F.exists("__w", lambda v: v.isNull()) & ~F.exists("__x", lambda v: v.isNull())
        return rows.select(*panel.keys, panel.ts, target, "__base", "__w", "__x", whole.alias("__whole"), F.col(ROW).alias("__at"))

    def predictions(self, matrix: DataFrame, panel: Panel, target: str, folds: DataFrame) -> DataFrame:
        """One-step-ahead forecasts over actual values, for every series and fold at once."""
        fitted, _ = self._fit(matrix, panel, target, folds)
        names = self._regressors()
        yhat = F.col("__base") + F.col("__theta")[len(names)]
        for k, c in enumerate(names):
            yhat = yhat + F.col("__theta")[k] * c
        return fitted.filter("role = 'valid'").select(
            *panel.keys, F.lit(self.name).alias("model"), "fold", F.col(panel.ts).alias("ts"),
            F.col(target).alias("y_true"), yhat.alias("y_pred"),
        )

    def coefficients(self, matrix: DataFrame, panel: Panel, target: str, folds: DataFrame) -> DataFrame:
        """``(keys, fold, term, coefficient)``."""
        _, theta = self._fit(matrix, panel, target, folds)
        terms = [f"ar_{i}" for i in self.ar] + [f"ma_{j}" for j in self.ma] + list(self.exog) + ["constant"]
        pairs = F.arrays_zip(F.array(*[F.lit(t) for t in terms]).alias("term"), F.col("__theta").alias("coefficient"))
        return theta.select(*panel.keys, "fold", F.explode(pairs).alias("p")).select(*panel.keys, "fold", "p.*")

    def _fit(self, matrix: DataFrame, panel: Panel, target: str, folds: DataFrame) -> tuple[DataFrame, DataFrame]:
        rows = assign_folds(self.history(matrix, panel, target).filter("__whole"), panel, folds).drop("fold_from")
        by_fold = Panel((*panel.keys, "fold"), panel.ts, panel.freq, panel.unit_rows)
        train = F.col("role") == "train"
        phi = self._long_fit(matrix, panel, target, folds, rows)
        rows = attach(rows, by_fold, phi)
        theta = least_squares(rows.filter(train), by_fold.keys, self._regressors(), self._w(0), "__theta")
        return attach(rows, by_fold, theta), theta

    def _long_fit(self, matrix: DataFrame, panel: Panel, target: str, folds: DataFrame, rows: DataFrame | None = None) -> DataFrame:
        """First stage: a long autoregression, whose residuals stand for the innovations."""
        if rows is None:
            rows = assign_folds(self.history(matrix, panel, target).filter("__whole"), panel, folds, roles=("train",))
        return least_squares(rows.filter(F.col("role") == "train"), (*panel.keys, "fold"), [self._w(i) for i in self.long_ar], self._w(0), "__phi")

    def forecast_path(self, matrix: DataFrame, panel: Panel, target: str, folds: DataFrame, horizon: int,
                      future: DataFrame | None = None) -> DataFrame:
        """Multi-step forecasts from the end of each training window, fed by their own values.

        Needs only the last rows of each window, so every (series, fold) is one small group. Every step comes out,
        the first one a grid step after the window's end. Where that row is absent, where one of the rows that the path
        starts from has a missing value or lag, or where there are too few training rows to fit, ``y_pred`` is null and
        ``reason`` says so: a path never starts earlier and never steps over a hole.

        Outside columns are looked up by the time of each step: in the matrix, as in a backtest, and in ``future`` (keys, time and
        outside columns), whose rows come after it. From the first step that lacks one on, ``y_pred`` is null with a reason.
        """
        _, theta = self._fit(matrix, panel, target, folds)
        by_fold = Panel((*panel.keys, "fold"), panel.ts, panel.freq, panel.unit_rows)
        # What a step looks back on: values to undo the differences, differenced values, innovations.
        need, keys, ts = max(1, *self.diff, *self.ar, *self.ma), list(panel.keys), panel.ts
        rows = assign_folds(self.history(matrix, panel, target), panel, folds, roles=("train",))
        tail = first_n(rows.select(*keys, "fold", ts, F.col(target).alias("__y"), "__w", "__x", "__whole", "__at"), by_fold, need, last=True)
        phi = self._long_fit(matrix, panel, target, folds)
        tail = tail.join(phi, [*keys, "fold"], "left")
        ahead = self._steps_ahead(matrix, panel, target, folds, horizon, future)
        slim = tail.select(*keys, "fold", ts, "__y", "__at", "__whole", self._w(0).alias("__d"), self._innovation(0).alias("__e"))
        groups = slim.groupBy(*keys, "fold").agg(F.collect_list(F.struct(ts, "__y", "__at", "__whole", "__d", "__e")).alias("__rows"))
        ready = (
            folds.select(*keys, "fold", "train_end").join(theta, [*keys, "fold"], "left").join(groups, [*keys, "fold"], "left")
            .join(ahead, [*keys, "fold"], "left")
        )
        types = dict(ready.dtypes)
        schema = (", ".join(f"`{k}` {types[k]}" for k in keys)
                  + f", model string, fold int, h int, ts {types['train_end']}, y_pred double, reason string")
        ar, ma, diff, name, step = self.ar, self.ma, self.diff, self.name, panel.step
        n_outside = len(self.exog)

        def walk(end, theta, rows, ahead) -> tuple[list[float | None], str | None | list[str | None]]:
            none = [None] * horizon
            rows = sorted(rows if rows is not None else [], key=lambda r: r["__at"])
            if not rows or rows[-1][ts] != end:
                return none, "no row at the end of the training window"
            if len(rows) < need:
                return none, "too few rows before the first step"
            if any(b["__at"] - a["__at"] != 1 for a, b in zip(rows, rows[1:])) or not all(r["__whole"] for r in rows):
                return none, "missing values before the first step"
            if theta is None:
                return none, "too few training rows to fit"
            y, d, e = ([r[c] for r in rows] for c in ("__y", "__d", "__e"))
            outside = {r["h"]: list(r["__x"]) for r in ahead} if ahead is not None else {}
            for h in range(1, horizon + 1):
                now = outside.get(h, []) if n_outside else []
                if len(now) < n_outside or any(v is None or v != v for v in now):
                    done = y[len(rows):]
                    return done + [None] * (horizon - len(done)), [None] * len(done) + ["no outside value at a step"] * (horizon - len(done))
                x = [d[-i] for i in ar] + [e[-j] for j in ma] + now + [1.0]
                d.append(float(np.dot(theta, x)))
                e.append(0.0)
                y.append(d[-1] - sum(c * y[-k] for k, c in diff.items() if k))
            return y[len(rows):], None

        def run(batches):
            for pdf in batches:
                parts = []
                for r in pdf.to_dict("records"):
                    path, reason = walk(r["train_end"], r["__theta"], r["__rows"], r["__ahead"])
                    got = pd.DataFrame({"h": range(1, horizon + 1), "y_pred": pd.Series(path, dtype="float64"), "reason": reason})
                    got["ts"] = [r["train_end"] + pd.Timedelta(seconds=h * step) for h in got["h"]]
                    for k in keys:
                        got[k] = r[k]
                    got["model"], got["fold"] = name, r["fold"]
                    parts.append(got[[*keys, "model", "fold", "h", "ts", "y_pred", "reason"]])
                if parts:
                    yield pd.concat(parts)

        return ready.mapInPandas(run, schema)


    def _steps_ahead(self, matrix: DataFrame, panel: Panel, target: str, folds: DataFrame, horizon: int, future: DataFrame | None) -> DataFrame:
        """(keys, fold, __ahead): of each step that has a row, h and the differenced outside columns."""
        keys, ts = list(panel.keys), panel.ts
        if not self.exog:
            return folds.select(*keys, "fold", F.lit(None).cast("array<struct<h:int,__x:array<double>>>").alias("__ahead"))
        known = matrix.select(*keys, ts, F.col(target).cast("double").alias(target), *[F.col(c).cast("double").alias(c) for c in self.exog])
        if future is not None:
            need_columns(future, [*keys, ts, *self.exog])
            # Rows that the matrix has as well are taken from there.
            more = future.select(*keys, ts, F.lit(None).cast("double").alias(target), *[F.col(c).cast("double").alias(c) for c in self.exog])
            known = known.unionByName(more.join(known, [*keys, ts], "left_anti"))
        at = (F.col("train_end").cast("timestamp") + F.make_dt_interval(secs=F.col("h") * panel.step)).cast("timestamp_ntz")
        steps = folds.select(*keys, "fold", "train_end", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h")).withColumn(ts, at)
        found = steps.join(self.history(known, panel, target).select(*keys, ts, "__x"), [*keys, ts])
        # At most one row per step of the horizon.
        return found.groupBy(*keys, "fold").agg(F.collect_list(F.struct("h", "__x")).alias("__ahead"))


def _grid(short: int, long: int, season: int) -> list[int]:
    return sorted({i + season * j for i in range(short + 1) for j in range(long + 1)} - {0})


def _convolve(a: dict[int, float], b: dict[int, float]) -> dict[int, float]:
    out: dict[int, float] = {}
    for i, x in a.items():
        for j, y in b.items():
            out[i + j] = out.get(i + j, 0.0) + x * y
    return out


def least_squares(rows: DataFrame, keys: Sequence[str], x: Iterable[Column], y: Column, name: str) -> DataFrame:
    """Least squares with a constant per group: ``(keys, name)`` with the coefficients as an array.

    The cross products are one aggregation; each result row holds one group's
    normal equations and is solved on its own. A group with no more rows than coefficients has no result row:
    its weights would be arbitrary.
    """
    cols = [*x, F.lit(1.0), y]
    size = len(cols)
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    data = rows.select(*keys, *[c.alias(f"c{i}") for i, c in enumerate(cols)])
    sums = data.groupBy(*keys).agg(*[F.sum(F.col(f"c{i}") * F.col(f"c{j}")).alias(f"s{i}_{j}") for i, j in pairs])
    packed = sums.select(*keys, F.array(*[F.col(f"s{i}_{j}") for i, j in pairs]).alias("__s"))
    types = dict(packed.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + f", {name} array<double>"
    constant = pairs.index((size - 2, size - 2))  # the sum of ones: the rows

    def solve(batches):
        for pdf in batches:
            coefs = []
            pdf = pdf[np.fromiter((s[constant] >= size for s in pdf["__s"]), bool, len(pdf))]
            for s in pdf["__s"]:
                g = np.zeros((size, size))
                for (i, j), v in zip(pairs, s):
                    g[i, j] = g[j, i] = v
                p = size - 1
                scale = RIDGE * np.trace(g[:p, :p]) / p
                coefs.append(np.linalg.solve(g[:p, :p] + scale * np.eye(p), g[:p, p]).tolist())
            yield pdf[list(keys)].assign(**{name: coefs})

    return packed.mapInPandas(solve, schema)
