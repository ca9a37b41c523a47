"""Multiplicative seasonal ARIMA by conditional sums of squares.

With z the differenced series less its constant and outside columns, the innovations follow the recurrence
e[t] = z[t] - sum a[k] z[t-k] - sum m[k] e[t-k], where a and m are the lags of the multiplied-out polynomials
(1 - ar(B)) (1 - seasonal ar(B^s)) and (1 + ma(B)) (1 + seasonal ma(B^s)). Gauss-Newton steps, damped after Levenberg and
Marquardt, lower the sum of squared innovations of the training rows.

Series are cut into blocks. A block run from nothing ends in a state that is right but for what the state before it
leaves, which is linear; so blocks are run apart, their end states put together, and run again from the right start. Derivatives
are differences of runs under shifted parameters, side by side. Windows of one block are fitted in one task from start to end.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.operators.arima import _convolve
from chronopanel.operators.evaluate import first_n
from chronopanel.panel import Panel, PanelError, missing_as_null, need_columns
from chronopanel.plans.folds import assign_folds
from chronopanel.plans.units import BLOCK, HALO, ROW, row_blocks, small_join
from chronopanel.session import materialize

SHIFT = 1e-5
# First guess of every autoregressive and moving-average weight.
START_AR, START_MA = 0.1, -0.4
# Squares must fall by this share for a fit to go on.
LEAST = 1e-7
STATE = "params array<double>, best array<double>, sse double, damp double, done boolean, again boolean"


@dataclass(frozen=True)
class CssArima:
    order: tuple[int, int, int] = (1, 1, 1)
    seasonal: tuple[int, int, int, int] = (1, 1, 1, 24)
    exog: tuple[str, ...] = ()
    constant: bool = False
    rounds: int = 30
    name: str = "seasonal_arima"

    def __post_init__(self) -> None:
        if self.order[1] not in (0, 1) or self.seasonal[1] not in (0, 1):
            raise PanelError("differencing orders must be 0 or 1")
        if self.seasonal[3] < 2:
            raise PanelError("the season must be at least 2 rows")

    def get_hyperparameters(self) -> dict[str, Any]:
        return {"order": self.order, "seasonal": self.seasonal, "exog": list(self.exog), "constant": self.constant}

    # --- the model ---

    @property
    def terms(self) -> list[str]:
        s = self.seasonal[3]
        return ([f"ar_{i + 1}" for i in range(self.order[0])] + [f"ar_{s * (i + 1)}" for i in range(self.seasonal[0])]
                + [f"ma_{i + 1}" for i in range(self.order[2])] + [f"ma_{s * (i + 1)}" for i in range(self.seasonal[2])]
                + list(self.exog) + (["constant"] if self.constant else []))

    @property
    def diff(self) -> dict[int, float]:
        out = {0: 1.0}
        for on, lag in ((self.order[1], 1), (self.seasonal[1], self.seasonal[3])):
            if on:
                out = _convolve(out, {0: 1.0, lag: -1.0})
        return out

    @property
    def reach(self) -> int:
        """Rows before a row that its innovation looks back on."""
        return max(self.diff) + self.order[0] + self.seasonal[0] * self.seasonal[3]

    @property
    def state_size(self) -> int:
        return max(1, self.order[2] + self.seasonal[2] * self.seasonal[3])

    def lags(self, params: np.ndarray) -> tuple[dict[int, float], dict[int, float], np.ndarray, float]:
        """Weights a and m by lag, those of outside columns, the constant."""
        p, _, q = self.order
        sp, _, sq, s = self.seasonal
        at, parts = 0, []
        for n in (p, sp, q, sq, len(self.exog)):
            parts.append(params[at : at + n])
            at += n
        poly = lambda w, step, sign: {0: 1.0} | {step * (i + 1): sign * float(v) for i, v in enumerate(w)}
        a = _convolve(poly(parts[0], 1, -1.0), poly(parts[1], s, -1.0))
        m = _convolve(poly(parts[2], 1, 1.0), poly(parts[3], s, 1.0))
        return {k: -v for k, v in a.items() if k}, {k: v for k, v in m.items() if k}, parts[4], float(params[at]) if self.constant else 0.0

    def start(self) -> list[float]:
        p, _, q = self.order
        sp, _, sq, _ = self.seasonal
        return [START_AR] * (p + sp) + [START_MA] * (q + sq) + [0.0] * (len(self.exog) + self.constant)

    def differenced(self, v: np.ndarray) -> np.ndarray:
        out = np.full(len(v), np.nan)
        n = max(self.diff)
        out[n:] = sum(c * v[n - k : len(v) - k] for k, c in self.diff.items())
        return out

    def run(self, y: np.ndarray, x: np.ndarray, many: np.ndarray, state: np.ndarray, halo: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Innovations of a block's own rows under each of ``many`` parameter rows, whether each row has all it looks back on, and z
        under the first of them. ``state`` holds the innovations before the block, oldest first, under each."""
        w = self.differenced(y)
        dx = np.column_stack([self.differenced(c) for c in x]) if len(x) else np.zeros((len(y), 0))
        n, size = len(y) - halo, self.state_size
        e = np.concatenate((state, np.zeros((len(many), n))), axis=1)
        u = np.empty((len(many), n))
        taps, z0 = None, None
        for k, params in enumerate(many):
            a, m, beta, c = self.lags(params)
            z = w - dx @ beta - c
            back = np.full(len(z), np.nan)
            reach = max(a, default=0)
            back[reach:] = z[reach:] - sum(v * z[reach - lag : len(z) - lag] for lag, v in a.items()) if a else z
            u[k] = back[halo:]
            taps = sorted(m) if taps is None else taps
            if k == 0:
                z0 = z[halo:]
                weights = np.zeros((len(many), len(m)))
            weights[k] = [m[lag] for lag in taps]
        whole = ~np.isnan(u[0])
        u = np.where(whole, u, 0.0)
        back_to = np.array([-lag for lag in taps], dtype=int)
        with np.errstate(over="ignore", invalid="ignore"):
            for t in range(n):
                # A row that lacks what it looks back on has an innovation of 0.
                if whole[t]:
                    e[:, size + t] = u[:, t] - (e[:, size + t + back_to] * weights).sum(axis=1)
        return e[:, size:], whole, z0

    def shifted(self, params: np.ndarray) -> np.ndarray:
        return np.vstack([params, params + SHIFT * np.eye(len(params))])

    def products(self, e: np.ndarray, use: np.ndarray) -> np.ndarray:
        """Upper sums of one block: derivative products, derivatives times innovations, squares, rows."""
        e = e[:, use]
        with np.errstate(over="ignore", invalid="ignore"):
            j = (e[1:] - e[0]) / SHIFT
            return np.concatenate(((j @ j.T).ravel(), j @ e[0], [e[0] @ e[0], float(use.sum())]))

    def step(self, s: dict, total: np.ndarray) -> dict:
        """The next state of a fit, from the sums under its present parameters."""
        p = len(self.terms)
        jj, je, sse, n = total[: p * p].reshape(p, p), total[p * p : p * p + p], total[-2], total[-1]
        if s["done"]:
            return s
        if n < 2 * p + 1:
            return s | {"best": None, "done": True}
        better = np.isfinite(total).all() and (s["sse"] is None or sse <= s["sse"])
        if better:
            small = s["sse"] is not None and not s["again"] and s["sse"] - sse <= LEAST * s["sse"]
            damp = s["damp"] if s["again"] else max(s["damp"] / 10, 1e-9)
            s = s | {"best": s["params"], "sse": float(sse), "damp": damp, "done": bool(small), "again": False}
        else:
            # Back to the best, with shorter steps; its sums are made again in the next round.
            return s | {"params": s["best"], "damp": s["damp"] * 30, "done": s["damp"] > 1e8 or s["best"] is None, "again": True}
        if p and not s["done"]:
            grip = jj + s["damp"] * np.diag(np.maximum(np.diag(jj), 1e-12))
            move = np.linalg.solve(grip, je)
            s["params"] = (np.array(s["params"]) - move).tolist()
        return s

    # --- fitting ---

    def blocks(self, matrix: DataFrame, panel: Panel, target: str, folds: DataFrame) -> DataFrame:
        """A row per block of a (series, fold): arrays of its rows from the first training row to the last validation row, preceded by
        those that they look back on. role: 0 training, 1 between, 2 validation."""
        need_columns(matrix, [target, *self.exog])
        keys, ts = list(panel.keys), panel.ts
        slim = missing_as_null(matrix.select(*keys, ts, *[F.col(c).cast("double").alias(c) for c in (target, *self.exog)]), [target, *self.exog])
        plan = folds.select(*keys, "fold", "train_start", F.col("valid_end").alias("train_end"))
        rows = assign_folds(slim, panel, plan, roles=("train",)).drop("role", "fold_from")
        rows = small_join(rows, folds.select(*keys, "fold", F.col("train_end").alias("__te"), F.col("valid_start").alias("__vs")), [*keys, "fold"])
        role = F.when(F.col(ts) <= F.col("__te"), 0).when(F.col(ts) >= F.col("__vs"), 2).otherwise(1)
        by_fold = Panel((*keys, "fold"), ts, panel.freq, panel.unit_rows)
        cut = row_blocks(rows.select(*keys, "fold", ts, target, *self.exog, role.alias("__role")), by_fold, back=self.reach)
        each = F.array_sort(F.collect_list(F.struct(F.col(ROW).alias("i"), F.col(HALO).alias("halo"), F.col(ts).alias("ts"), F.col("__role").alias("role"),
                                                    F.col(target).alias("y"), *[F.col(c).alias(f"x{i}") for i, c in enumerate(self.exog)])))
        # A block has unit_rows rows and the halo; one of halo rows alone is none.
        return cut.groupBy(*keys, "fold", F.col(BLOCK).alias("block")).agg(each.alias("rows")).filter(F.exists("rows", lambda r: ~r["halo"]))

    def _arrays(self, rows: Sequence) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        y = np.array([r["y"] for r in rows], dtype=float)
        x = np.array([[r[f"x{i}"] for r in rows] for i in range(len(self.exog))], dtype=float).reshape(len(self.exog), len(rows))
        return y, x, np.array([r["role"] for r in rows]), sum(r["halo"] for r in rows)

    def fit(self, matrix: DataFrame, panel: Panel, target: str, folds: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
        """(blocks, weights, whether any window has several blocks); ``weights``: (keys, fold, params), null where too few rows train."""
        keys = [*panel.keys, "fold"]
        blocks = materialize(self.blocks(matrix, panel, target, folds))
        several = bool(blocks.filter("block > 0").limit(1).count())
        types = dict(blocks.dtypes)
        head = ", ".join(f"`{k}` {types[k]}" for k in keys)
        model, p, fresh = self, len(self.terms), {"params": self.start(), "best": None, "sse": None, "damp": 1e-3, "done": False, "again": False}
        if not several:
            def whole(batches):
                for pdf in batches:
                    out = []
                    for r in pdf.to_dict("records"):
                        y, x, role, halo = model._arrays(r["rows"])
                        s, zero = dict(fresh), np.zeros((p + 1, model.state_size))
                        for _ in range(model.rounds):
                            e, use, _ = model.run(y, x, model.shifted(np.array(s["params"])), zero, halo)
                            s = model.step(s, model.products(e, use & (role[halo:] == 0)))
                            if s["done"]:
                                break
                        out.append([r[k] for k in keys] + [s["best"]])
                    yield pd.DataFrame(out, columns=[*keys, "params"])

            return blocks, materialize(blocks.select(*keys, "rows").mapInPandas(whole, f"{head}, params array<double>")), several

        columns = ("params", "best", "sse", "damp", "done", "again")
        state = blocks.select(*keys).distinct().select("*", F.lit(fresh["params"]).cast("array<double>").alias("params"), F.lit(None).cast("array<double>").alias("best"),
                                                       F.lit(None).cast("double").alias("sse"), F.lit(1e-3).alias("damp"), F.lit(False).alias("done"), F.lit(False).alias("again"))
        state = materialize(state)
        for _ in range(self.rounds):
            open_ = state.filter("not done")
            if not open_.limit(1).count():
                break
            sums = self._sums(blocks, open_.select(*keys, "params"), keys)

            def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
                r = pdf.iloc[0]
                s = {c: r[c] for c in columns}
                s = s | {"params": list(s["params"]), "best": None if s["best"] is None else list(s["best"]), "sse": None if pd.isna(s["sse"]) else s["sse"], "done": bool(s["done"]), "again": bool(s["again"])}
                s = model.step(s, np.sum([np.array(v) for v in pdf["total"]], axis=0))
                return pd.DataFrame([[*key, *[s[c] for c in columns]]], columns=[*keys, *columns])

            # A group is a row of some numbers per block.
            moved = open_.join(sums, keys).groupBy(*keys).applyInPandas(solve, f"{head}, {STATE}")
            state = materialize(state.filter("done").unionByName(moved))
        return blocks, state.select(*keys, F.col("best").alias("params")), several

    def _starts(self, blocks: DataFrame, params: DataFrame, keys: list[str], shifted: bool) -> DataFrame:
        """(keys, block, params, rows, state): the innovations before each block, under the parameters and their shifts."""
        model, size = self, self.state_size
        types = dict(blocks.dtypes)
        head = ", ".join(f"`{k}` {types[k]}" for k in keys)
        joined = small_join(blocks, params, keys)

        def ends(batches):
            for pdf in batches:
                out = []
                for r in pdf.to_dict("records"):
                    y, x, _, halo = model._arrays(r["rows"])
                    many = model.shifted(np.array(r["params"])) if shifted else np.array([r["params"]])
                    e, whole, _ = model.run(y, x, many, np.zeros((len(many), size)), halo)
                    e = np.concatenate((np.zeros((len(many), size)), e), axis=1)[:, -size:]
                    # Lengths of runs of rows, negative where rows lack something and the state before them ends.
                    edges = np.flatnonzero(np.concatenate(([True], whole[1:] != whole[:-1], [True])))
                    runs = np.where(whole[edges[:-1]], 1, -1) * np.diff(edges)
                    out.append([r[k] for k in keys] + [r["block"], list(r["params"]), runs.tolist(), e.ravel().tolist()])
                yield pd.DataFrame(out, columns=[*keys, "block", "params", "runs", "last"])

        # What a block leaves is one row; a chain of them is put together per (series, fold).
        left = joined.mapInPandas(ends, f"{head}, block bigint, params array<double>, runs array<bigint>, last array<double>")

        def chain(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("block")
            params = np.array(pdf["params"].iloc[0])
            many = model.shifted(params) if shifted else params[None]
            shift, forms = np.diag(np.ones(size - 1), 1), []
            for row in many:
                form = shift.copy()
                for lag, v in model.lags(row)[1].items():
                    form[-1, size - lag] = -v
                forms.append(form)
            state, out = np.zeros((len(many), size)), []
            for block, runs, last in zip(pdf["block"], pdf["runs"], pdf["last"], strict=True):
                out.append([*key, block, state.ravel().tolist()])
                with np.errstate(over="ignore", invalid="ignore"):
                    for n in runs:
                        state = np.array([np.linalg.matrix_power(f if n > 0 else shift, abs(int(n))) @ s for f, s in zip(forms, state, strict=True)])
                    state = state + np.array(last).reshape(len(many), size)
            return pd.DataFrame(out, columns=[*keys, "block", "state"])

        states = left.groupBy(*keys).applyInPandas(chain, f"{head}, block bigint, state array<double>")
        return joined.join(states, [*keys, "block"])

    def _sums(self, blocks: DataFrame, params: DataFrame, keys: list[str]) -> DataFrame:
        model, size = self, self.state_size
        types = dict(blocks.dtypes)
        head = ", ".join(f"`{k}` {types[k]}" for k in keys)

        def add(batches):
            for pdf in batches:
                out = []
                for r in pdf.to_dict("records"):
                    y, x, role, halo = model._arrays(r["rows"])
                    many = model.shifted(np.array(r["params"]))
                    e, use, _ = model.run(y, x, many, np.array(r["state"]).reshape(len(many), size), halo)
                    out.append([r[k] for k in keys] + [model.products(e, use & (role[halo:] == 0)).tolist()])
                yield pd.DataFrame(out, columns=[*keys, "total"])

        return self._starts(blocks, params, keys, True).mapInPandas(add, f"{head}, total array<double>")

    # --- what a fit is used for ---

    def _walked(self, blocks: DataFrame, params: DataFrame, keys: list[str], several: bool) -> DataFrame:
        """A row per row of the blocks: keys, fold, ts, at, role, y, z, e, whole."""
        model, size = self, self.state_size
        types = dict(blocks.dtypes)
        head = ", ".join(f"`{k}` {types[k]}" for k in keys)
        kind = blocks.schema["rows"].dataType.elementType["ts"].dataType.simpleString()
        known = params.filter(F.col("params").isNotNull())
        joined = self._starts(blocks, known, keys, False) if several else small_join(blocks, known, keys).withColumn("state", F.array_repeat(F.lit(0.0), size))

        def walk(batches):
            for pdf in batches:
                for r in pdf.to_dict("records"):
                    y, x, role, halo = model._arrays(r["rows"])
                    e, whole, z = model.run(y, x, np.array([r["params"]]), np.array(r["state"]).reshape(1, size), halo)
                    own = r["rows"][halo:]
                    yield pd.DataFrame({**{k: [r[k]] * len(own) for k in keys}, "ts": [v["ts"] for v in own], "at": [v["i"] for v in own], "role": role[halo:],
                                        "y": y[halo:], "z": z, "e": e[0], "whole": whole})

        out = joined.mapInPandas(walk, f"{head}, ts {kind}, at bigint, role int, y double, z double, e double, whole boolean")
        return missing_as_null(out, ["y", "z"])

    def predictions(self, matrix: DataFrame, panel: Panel, target: str, folds: DataFrame) -> DataFrame:
        """One-step-ahead forecasts over actual values. Rows that lack what they look back on, and windows with too few rows to fit, have none."""
        keys = [*panel.keys, "fold"]
        blocks, params, several = self.fit(matrix, panel, target, folds)
        rows = self._walked(blocks, params, keys, several).filter("role = 2 and whole")
        return rows.select(*panel.keys, F.lit(self.name).alias("model"), "fold", "ts", F.col("y").alias("y_true"), (F.col("y") - F.col("e")).alias("y_pred"))

    def coefficients(self, matrix: DataFrame, panel: Panel, target: str, folds: DataFrame) -> DataFrame:
        """``(keys, fold, term, coefficient)``; none for windows with too few rows to fit."""
        _, params, _ = self.fit(matrix, panel, target, folds)
        pairs = F.arrays_zip(F.array(*[F.lit(t) for t in self.terms]).alias("term"), F.col("params").alias("coefficient"))
        return params.filter(F.col("params").isNotNull()).select(*panel.keys, "fold", F.explode(pairs).alias("p")).select(*panel.keys, "fold", "p.*")

    def innovations(self, matrix: DataFrame, panel: Panel, target: str, folds: DataFrame, given: Mapping[str, float]) -> DataFrame:
        """(keys, fold, ts, at, e, whole) under given weights, by term: from the first training row on, with nothing before it."""
        keys = [*panel.keys, "fold"]
        if set(given) != set(self.terms):
            raise PanelError(f"weights are needed for {self.terms}")
        blocks = materialize(self.blocks(matrix, panel, target, folds))
        params = blocks.select(*keys).distinct().withColumn("params", F.lit([float(given[t]) for t in self.terms]).cast("array<double>"))
        several = bool(blocks.filter("block > 0").limit(1).count())
        return self._walked(blocks, params, keys, several).select(*keys, "ts", "at", "e", "whole")

    def forecast_path(self, matrix: DataFrame, panel: Panel, target: str, folds: DataFrame, horizon: int) -> DataFrame:
        """Multi-step forecasts from the end of each training window, fed by their own values: every step of every window.

        Where the window does not end in a row, where a row that the path starts from is missing or incomplete, where too few
        rows train, and from the first step on whose outside columns are not in the matrix, ``y_pred`` is null and ``reason`` says why.
        """
        keys, by_fold = [*panel.keys, "fold"], Panel((*panel.keys, "fold"), "ts", panel.freq, panel.unit_rows)
        need = max(self.reach, self.state_size)
        blocks, params, several = self.fit(matrix, panel, target, folds)
        walked = self._walked(blocks, params, keys, several)
        tail = first_n(walked.filter("role = 0"), by_fold, need, last=True)
        groups = tail.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "ts", "y", "z", "e", "whole"))).alias("tail"))
        ready = folds.select(*keys, "train_end").join(params, keys, "left").join(groups, keys, "left")
        if self.exog:
            # Differences of outside columns at the steps: over the matrix, whatever the windows are.
            lag = lambda c, w: sum((F.lag(c, k).over(w) * v for k, v in self.diff.items() if k), F.col(c) * 1.0)
            from chronopanel.plans.units import over_blocks

            slim = matrix.select(*panel.keys, panel.ts, *[F.col(c).cast("double").alias(c) for c in self.exog])
            moved = over_blocks(slim, panel, lambda b, w: b.withColumn("x", F.array(*[lag(c, w) for c in self.exog])), back=max(self.diff))
            at = (F.col("train_end").cast("timestamp") + F.make_dt_interval(secs=F.col("h") * panel.step)).cast("timestamp_ntz")
            steps = folds.select(*keys, "train_end", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h")).withColumn(panel.ts, at)
            ahead = steps.join(moved.select(*panel.keys, panel.ts, "x"), [*panel.keys, panel.ts]).groupBy(*keys).agg(F.collect_list(F.struct("h", "x")).alias("ahead"))
            ready = ready.join(ahead, keys, "left")
        else:
            ready = ready.withColumn("ahead", F.lit(None).cast("array<struct<h:int,x:array<double>>>"))
        types = dict(ready.dtypes)
        schema = ", ".join(f"`{k}` {types[k]}" for k in panel.keys) + f", model string, fold int, h int, ts {types['train_end']}, y_pred double, reason string"
        model, step, names = self, panel.step, list(panel.keys)

        def path(r: dict) -> tuple[list, list]:
            none, tail = [None] * horizon, r["tail"] if r["tail"] is not None else []
            if r["params"] is None:
                return none, ["too few training rows to fit"] * horizon
            if not len(tail) or tail[-1]["ts"] != r["train_end"]:
                return none, ["no row at the end of the training window"] * horizon
            if len(tail) < need:
                return none, ["too few rows before the first step"] * horizon
            if any(b["at"] - a["at"] != 1 for a, b in zip(tail, tail[1:])) or not all(v["whole"] for v in tail[-max(1, model.reach - max(model.diff)) :]):
                return none, ["missing values before the first step"] * horizon
            y, z, e = ([v[c] for v in tail] for c in ("y", "z", "e"))
            a, m, beta, c = model.lags(np.array(r["params"]))
            outside = {v["h"]: v["x"] for v in r["ahead"]} if r["ahead"] is not None else {}
            why: list = []
            for h in range(1, horizon + 1):
                x = outside.get(h)
                if len(beta) and (x is None or any(v is None or v != v for v in x)):
                    return y[len(tail) :] + [None] * (horizon - h + 1), why + ["no outside value at a step"] * (horizon - h + 1)
                z.append(sum(v * z[-k] for k, v in a.items()) + sum(v * e[-k] for k, v in m.items()))
                e.append(0.0)
                w = z[-1] + c + (float(np.dot(beta, x)) if len(beta) else 0.0)
                y.append(w - sum(v * y[-k] for k, v in model.diff.items() if k))
                why.append(None)
            return y[len(tail) :], why

        def run(batches):
            for pdf in batches:
                parts = []
                for r in pdf.to_dict("records"):
                    y, why = path(r)
                    got = pd.DataFrame({"h": range(1, horizon + 1), "y_pred": pd.Series(y, dtype="float64"), "reason": why})
                    got["ts"] = [r["train_end"] + pd.Timedelta(seconds=h * step) for h in got["h"]]
                    for k in names:
                        got[k] = r[k]
                    got["model"], got["fold"] = model.name, r["fold"]
                    parts.append(got[[*names, "model", "fold", "h", "ts", "y_pred", "reason"]])
                if parts:
                    yield pd.concat(parts)

        return ready.mapInPandas(run, schema)
