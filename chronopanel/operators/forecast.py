"""Forecasters and the backtest over folds."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chronopanel.operators.features import feature_names
from chronopanel.operators.trees import Ensemble, Growth, grow_folds
from chronopanel.panel import Panel, PanelError, missing_as_null, need_columns
from chronopanel.plans.folds import assign_folds
from chronopanel.plans.units import small_join
from chronopanel.session import new_folder

# Columns of every prediction table, after the series keys.
PREDICTION = ("model", "fold", "ts", "y_true", "y_pred")


class Forecaster(Protocol):
    """Fit on training rows, predict on rows that carry the same feature columns."""

    name: str

    def fit(self, train: DataFrame, target: str, features: Sequence[str]) -> "Fitted": ...

    def get_hyperparameters(self) -> dict[str, Any]: ...


class Fitted(Protocol):
    def predict(self, rows: DataFrame) -> DataFrame:
        """The rows with a ``y_pred`` column."""
        ...


# --- naive -----------------------------------------------------------------------

@dataclass(frozen=True)
class NaiveLag:
    """Predicts an existing lag column, so all folds and models share one projection."""

    column: str
    name: str

    def fit(self, train: DataFrame, target: str, features: Sequence[str]) -> "NaiveLag":
        need_columns(train, [self.column])
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        need_columns(rows, [self.column])
        return rows.withColumn("y_pred", F.col(self.column).cast("double"))

    def get_hyperparameters(self) -> dict[str, Any]:
        return {"column": self.column}


def naive_baselines(target: str) -> list[NaiveLag]:
    return [
        NaiveLag(f"{target}_lag_1h", "naive_lag_1h"),
        NaiveLag(f"{target}_lag_24h", "naive_lag_24h_daily"),
        NaiveLag(f"{target}_lag_168h", "naive_lag_168h_weekly"),
    ]


def naive_predictions(
    matrix: DataFrame, panel: Panel, target: str, folds: DataFrame, models: Sequence[NaiveLag]
) -> DataFrame:
    """Validation forecasts of several lag models over all folds in one job."""
    need_columns(matrix, [m.column for m in models])
    columns = sorted({m.column for m in models})
    slim = matrix.select(*panel.keys, panel.ts, target, *columns)
    valid = assign_folds(slim, panel, folds, roles=("valid",))
    each = F.array(*[
        F.struct(F.lit(m.name).alias("model"), F.col(m.column).cast("double").alias("y_pred")) for m in models
    ])
    return valid.withColumn("__m", F.explode(each)).select(
        *panel.keys, F.col("__m.model").alias("model"), "fold", F.col(panel.ts).alias("ts"),
        F.col(target).cast("double").alias("y_true"), F.col("__m.y_pred").alias("y_pred"),
    )


def seasonal_naive_path(history: DataFrame, panel: Panel, target: str, origin: DataFrame, horizon: int, season: int) -> DataFrame:
    """Multi-step forecast that repeats the last season before each origin.

    ``origin`` holds ``(keys, origin)``; step h takes the value h - ceil(h / season)
    seasons back, found by time, so it is one join on series and time. Every step comes out: where nothing was
    observed there, ``y_pred`` is null and ``reason`` says so.
    """
    steps = origin.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    back = F.ceil(F.col("h") / season) * season
    at = lambda n: (F.col("origin").cast("timestamp") + F.make_dt_interval(secs=n * panel.step)).cast("timestamp_ntz")
    wanted = steps.withColumn("__src", at(F.col("h") - back)).withColumn(panel.ts, at(F.col("h")))
    past = missing_as_null(history, [target]).select(*panel.keys, F.col(panel.ts).alias("__src"), F.col(target).alias("y_pred"))
    on = [*panel.keys, "__src"]
    # The history is looked up first, so that only rows of some step are joined to the steps.
    hit = small_join(past, wanted, on, fallback=lambda: past.join(wanted, on)).select(*panel.keys, "origin", "h", "y_pred", F.lit(True).alias("__hit"))
    reason = F.when(F.col("__hit").isNull(), "no observation a season back").when(F.col("y_pred").isNull(), "missing value a season back")
    return wanted.join(hit, [*panel.keys, "origin", "h"], "left").select(
        *panel.keys, "origin", "h", panel.ts, "y_pred", reason.alias("reason")
    )


# --- trees ------------------------------------------------------------------------

@dataclass
class FittedTrees:
    """Trees of one fold, or of several; ``rows`` to predict then have a column fold."""

    ensemble: Ensemble
    one: bool = True

    def predict(self, rows: DataFrame) -> DataFrame:
        need_columns(rows, self.ensemble.features)
        if not self.one:
            return self.ensemble.predict(rows)
        # The fold that a caller's rows may have is not that of the fit.
        held = rows.withColumnRenamed("fold", "__fold").withColumn("fold", F.lit(0))
        return self.ensemble.predict(held).drop("fold").withColumnRenamed("__fold", "fold")

    def importances(self, df: DataFrame | None = None) -> DataFrame:
        """One row per feature, and fold if there are several."""
        found = self.ensemble.importances()
        return found.drop("fold") if self.one else found


class TreeModel:
    """What tree models share: folds are fitted together, each from its own rows."""

    def growth(self) -> Growth:
        raise NotImplementedError

    def fit(self, train: DataFrame, target: str, features: Sequence[str]) -> FittedTrees:
        return FittedTrees(grow_folds(train.select(target, *features, F.lit(0).alias("fold")), target, features, self.growth()))

    def fit_folds(self, train: DataFrame, target: str, features: Sequence[str]) -> FittedTrees:
        return FittedTrees(grow_folds(train, target, features, self.growth()), one=False)


@dataclass
class BoostedTrees(TreeModel):
    """Gradient-boosted regression trees for squared loss: leaves shrunk by an L2 penalty, rows and columns sampled per tree."""

    trees: int = 500
    depth: int = 6
    step: float = 0.05
    row_share: float = 0.8
    column_share: float = 0.8
    bins: int = 256
    l2: float = 1.0
    seed: int = 42
    name: str = "gradient_boosted_trees"

    def growth(self) -> Growth:
        return Growth(self.trees, self.depth, self.bins, True, False, self.step, self.row_share, self.column_share, self.l2, 1.0, self.seed)

    def get_hyperparameters(self) -> dict[str, Any]:
        return {k: getattr(self, k) for k in ("trees", "depth", "step", "row_share", "column_share", "bins", "l2", "seed")}


@dataclass
class Forest(TreeModel):
    """Random forest regression: trees on rows drawn with replacement, averaged."""

    trees: int = 250
    depth: int = 16
    min_leaf: int = 5
    bootstrap: bool = True
    bins: int = 256
    seed: int = 42
    name: str = "random_forest"

    def growth(self) -> Growth:
        return Growth(self.trees, self.depth, self.bins, False, self.bootstrap, 1.0, 1.0, 1.0, 0.0, self.min_leaf, self.seed)

    def get_hyperparameters(self) -> dict[str, Any]:
        return {k: getattr(self, k) for k in ("trees", "depth", "min_leaf", "bootstrap", "bins", "seed")}


# --- user-supplied per-series models ---------------------------------------------------

@dataclass
class PerSeries:
    """Runs a pandas function on each (series, fold): ``fn(train, valid) -> predictions``.

    Each group holds one fold's rows of one series, which the fold plan bounds.
    """

    fn: Callable[[pd.DataFrame, pd.DataFrame], np.ndarray]
    name: str
    hyperparameters: Mapping[str, Any] = field(default_factory=dict)

    def predictions(self, matrix: DataFrame, panel: Panel, target: str, folds: DataFrame) -> DataFrame:
        rows = assign_folds(matrix, panel, folds).drop("fold_from")
        keys, ts, fn, name = list(panel.keys), panel.ts, self.fn, self.name
        types = dict(matrix.dtypes)
        schema = ", ".join([f"`{k}` {types[k]}" for k in keys]) + (
            f", model string, fold int, ts {types[ts]}, y_true double, y_pred double"
        )

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(ts)
            train, valid = pdf[pdf["role"] == "train"], pdf[pdf["role"] == "valid"]
            out = valid[keys].copy()
            out["model"], out["fold"], out["ts"] = name, valid["fold"].astype("int32"), valid[ts]
            out["y_true"] = valid[target].astype("float64")
            out["y_pred"] = np.asarray(fn(train, valid), dtype="float64") if len(valid) else np.empty(0)
            return out

        return rows.groupBy(*keys, "fold").applyInPandas(run, schema)

    def get_hyperparameters(self) -> dict[str, Any]:
        return dict(self.hyperparameters)


SERIES, SERIES_BUCKETS = "series_number", 1024


def with_series_number(df: DataFrame, panel: Panel) -> DataFrame:
    """Number the series 0, 1, .., by buckets of their hash and by key within; so no task sees all series."""
    keys = list(panel.keys)
    series = df.select(*keys).distinct().withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(SERIES_BUCKETS)))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    # One row per bucket.
    starts = series.groupBy("__bucket").count().select("__bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    within = F.row_number().over(Window.partitionBy("__bucket").orderBy(*keys)) - 1
    numbers = series.withColumn("__n", within).join(F.broadcast(starts), "__bucket").withColumn(SERIES, (F.col("__start") + F.col("__n")).cast("double"))
    return small_join(df, numbers.select(*keys, SERIES), keys)


# --- backtest ---------------------------------------------------------------------------

@dataclass
class Backtest:
    """Predictions, feature importances, fit seconds and fitted trees of a run."""

    predictions: DataFrame
    importances: DataFrame | None
    fits: DataFrame
    # Fitted trees, node by node; other models have nothing but their parameters.
    nodes: DataFrame | None = None

    def fold_results(self, scores: DataFrame) -> DataFrame:
        """Scores (by fold and model at least) with each fit's seconds; null for models that are not fitted."""
        return scores.join(F.broadcast(self.fits), ["fold", "model"], "left")


def _forecasts(rows: DataFrame, panel: Panel, target: str, name: str) -> DataFrame:
    return rows.select(*panel.keys, F.lit(name).alias("model"), F.col("fold").cast("int").alias("fold"), F.col(panel.ts).alias("ts"),
                       F.col(target).cast("double").alias("y_true"), "y_pred")


def backtest(
    matrix: DataFrame,
    panel: Panel,
    target: str,
    folds: DataFrame,
    models: Sequence[Any],
    features: Sequence[str] | None = None,
    store: bool = True,
    series_feature: bool = True,
    at_once: int = 3,
) -> Backtest:
    """Fit and predict every model on every fold.

    Lag models, and models with a ``predictions`` method of their own, run all
    folds in one job. Models with ``fit_folds`` (trees) are fitted over all series and folds together, others once per
    fold, some folds at a time. The fold-expanded rows are written once, in a folder per fold and role, so each fit reads its own rows only.
    ``series_feature`` adds the number of the series to the features of tree models, as series may differ in scale.
    """
    features = list(features or feature_names(matrix, panel, target))
    spark = matrix.sparkSession
    parts: list[DataFrame] = []
    gains: list[DataFrame] = []
    fits: list[tuple[str, int, float]] = []
    grown: list[DataFrame] = []
    naive = [m for m in models if isinstance(m, NaiveLag)]
    if naive:
        parts.append(naive_predictions(matrix, panel, target, folds, naive))
    panel_wide = [m for m in models if hasattr(m, "predictions")]
    for m in panel_wide:
        parts.append(m.predictions(matrix, panel, target, folds))
    fitted = [m for m in models if m not in naive and m not in panel_wide]
    if fitted:
        source = with_series_number(matrix, panel) if series_feature else matrix
        inputs = [*features, SERIES] if series_feature else features
        expanded = assign_folds(source, panel, folds).drop("fold_from")
        if store:
            path = new_folder(spark, "folds")
            expanded.write.partitionBy("fold", "role").parquet(path)
            expanded = spark.read.schema(expanded.schema).parquet(path)
        for m in [m for m in fitted if hasattr(m, "fit_folds")]:
            # All folds are fitted in step, so each has the seconds of the whole.
            started = time.perf_counter()
            fit = m.fit_folds(expanded.filter("role = 'train'"), target, inputs)
            took = time.perf_counter() - started
            parts.append(_forecasts(fit.predict(expanded.filter("role = 'valid'")), panel, target, m.name))
            fits += [(m.name, int(k), took) for k in fit.ensemble.means]
            gains.append(fit.importances().withColumn("model", F.lit(m.name)))
            grown.append(fit.ensemble.thresholds().withColumn("model", F.lit(m.name)))
        ids = sorted(r.fold for r in folds.select("fold").distinct().collect())

        def one(job: tuple[Any, int]) -> tuple[DataFrame, DataFrame | None, tuple[str, int, float]]:
            m, k = job
            of_fold = expanded.filter(F.col("fold") == k)
            started = time.perf_counter()
            fit = m.fit(of_fold.filter("role = 'train'"), target, inputs)
            took = (m.name, int(k), time.perf_counter() - started)
            preds = _forecasts(fit.predict(of_fold.filter("role = 'valid'")), panel, target, m.name)
            gain = None
            if hasattr(fit, "importances"):
                gain = fit.importances(matrix).withColumns({"model": F.lit(m.name), "fold": F.lit(k).cast("int")})
            return preds, gain, took

        # Of models that fit one fold at a time, other folds' jobs fill the gaps between one fold's.
        with ThreadPool(max(1, min(at_once, len(ids)))) as pool:
            for preds, gain, took in pool.imap(one, [(m, k) for m in fitted if not hasattr(m, "fit_folds") for k in ids]):
                parts.append(preds)
                fits.append(took)
                if gain is not None:
                    gains.append(gain)
    if not parts:
        raise PanelError("no models to run")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    all_of = lambda tables: reduce(DataFrame.unionByName, tables) if tables else None
    return Backtest(out, all_of(gains), spark.createDataFrame(fits, "model string, fold int, fit_seconds double"), all_of(grown))


# --- runs that can be taken up again -------------------------------------------------------

COMMIT = "model string, fold int, rows bigint, fit_seconds double, parameters string, plan bigint"


def _read(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame | None:
    """The table under a path, or None where nothing was written yet."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return None
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def resumable_backtest(
    matrix: DataFrame, panel: Panel, target: str, folds: DataFrame, models: Sequence[Any], folder: str, max_fits: int | None = None, **options: Any
) -> Backtest | None:
    """A `backtest` that keeps what each (model, fold) gave under ``folder`` and does not do it again.

    Predictions, importances and trees of a fold are written first, its row in ``commits`` last; what has no such row is
    fitted again and replaces what a run that broke off left behind. A row also holds the model's parameters and a digest of the fold's
    bounds, and counts only while both are the same. With ``max_fits`` a call ends after so many (model, fold); None is returned until all are there.
    """
    spark = matrix.sparkSession
    folder = folder.rstrip("/")
    ends = F.sum(F.xxhash64(*panel.keys, "train_start", "train_end", "valid_start", "valid_end").cast("decimal(38,0)") % (1 << 60)).cast("bigint")
    plan = {r["fold"]: r["d"] for r in folds.groupBy(F.col("fold").cast("int").alias("fold")).agg(ends.alias("d")).collect()}
    if len({m.name for m in models}) < len(models):
        raise PanelError("models need names of their own")
    said = {m.name: json.dumps(m.get_hyperparameters(), sort_keys=True, default=str) for m in models}
    commits = _read(spark, f"{folder}/commits", COMMIT)
    rows = commits.collect() if commits is not None else []  # one per model and fold
    done = {(r["model"], r["fold"]) for r in rows if said.get(r["model"]) == r["parameters"] and plan.get(r["fold"]) == r["plan"]}
    left = [(m, k) for m in models for k in sorted(plan) if (m.name, k) not in done]
    now = left if max_fits is None else left[:max_fits]
    for m in models:
        ids = [k for of, k in now if of is m]
        if not ids:
            continue
        run = backtest(matrix, panel, target, folds.filter(F.col("fold").isin(ids)), [m], **options)
        for name, table in (("predictions", run.predictions), ("importances", run.importances), ("nodes", run.nodes)):
            if table is not None:
                for k in ids:
                    table.filter(F.col("fold") == k).drop("model", "fold").write.mode("overwrite").parquet(f"{folder}/{name}/model={m.name}/fold={k}")
        took = {r["fold"]: r["fit_seconds"] for r in run.fits.collect()}
        sizes = {r["fold"]: r["count"] for r in _kept(spark, folder, "predictions", [(m.name, k) for k in ids]).groupBy("fold").count().collect()}
        new = [(m.name, k, sizes.get(k, 0), took.get(k), said[m.name], plan[k]) for k in ids]
        spark.createDataFrame(new, COMMIT).coalesce(1).write.mode("append").parquet(f"{folder}/commits")
    if len(now) < len(left):
        return None
    pairs = [(m.name, k) for m in models for k in sorted(plan)]
    last = {(r["model"], r["fold"]): r for r in _read(spark, f"{folder}/commits", COMMIT).collect() if said.get(r["model"]) == r["parameters"] and plan.get(r["fold"]) == r["plan"]}
    fits = spark.createDataFrame([(m, k, last[m, k]["fit_seconds"]) for m, k in pairs if last[m, k]["fit_seconds"] is not None], "model string, fold int, fit_seconds double")
    return Backtest(_kept(spark, folder, "predictions", pairs), _kept(spark, folder, "importances", pairs), fits, _kept(spark, folder, "nodes", pairs))


def _kept(spark: SparkSession, folder: str, name: str, pairs: list[tuple[str, int]]) -> DataFrame | None:
    """What was kept of the given models and folds, of those that have such a table."""
    found = _read(spark, f"{folder}/{name}")
    if found is None:
        return None
    wanted = spark.createDataFrame(pairs, "model string, fold int")
    return found.withColumns({"model": F.col("model").cast("string"), "fold": F.col("fold").cast("int")}).join(F.broadcast(wanted), ["model", "fold"], "left_semi")
