"""Scoring forecasts: metrics, leaderboards, segments, significance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.functions.metrics import METRICS, PERCENT_METRICS, Metric, mae, paired
from chronopanel.functions.special import t_p_value
from chronopanel.panel import Panel, PanelError
from chronopanel.plans.folds import assign_folds
from chronopanel.plans.units import CHUNK, add_chunk, over_blocks

LEADERBOARD_METRICS = ("MAE", "RMSE", "WAPE", "sMAPE", "MASE")
SEASON = 24
# What `score` adds besides rows and metrics.
CHECKS = ("paired_rows", "missing_predictions", "undefined")


def mase_scale(
    matrix: DataFrame, panel: Panel, target: str, folds: DataFrame, season: int = SEASON
) -> DataFrame:
    """Mean absolute seasonal difference of each fold's training rows, by row position.

    The difference to the row ``season`` positions earlier is taken once for
    the whole series. It belongs to a fold when both rows are in its training
    window, which the earlier row's timestamp tells.
    """
    if season < 1:
        raise PanelError("the seasonal period must be at least 1")

    def seasonal_difference(blocks: DataFrame, w) -> DataFrame:
        return blocks.select(
            "*",
            F.abs(F.col(target) - F.lag(target, season).over(w)).alias("__d"),
            F.lag(panel.ts, season).over(w).alias("__from"),
        )

    slim = matrix.select(*panel.keys, panel.ts, target)
    diffs = over_blocks(slim, panel, seasonal_difference, back=season)
    in_train = assign_folds(diffs, panel, folds, roles=("train",))
    # The fold's first `season` rows compare with rows before its window.
    return (
        in_train.groupBy(*panel.keys, "fold")
        .agg(
            F.count(F.lit(1)).alias("train_rows"),
            F.avg(F.when(F.col("__from") >= F.col("fold_from"), F.col("__d"))).alias("scale"),
        )
        .withColumn("scale", F.when(F.col("scale") > 0, F.col("scale")))
    )


def stack_scale(predictions: DataFrame, panel: Panel, holdout: int, season: int = SEASON) -> DataFrame:
    """As `mase_scale`, but over what a stack learns from: the truth of the folds before ``holdout``, one after another.

    ``predictions`` may hold several models; a row counts once. The result is of the fold ``holdout``.
    """
    if season < 1:
        raise PanelError("the seasonal period must be at least 1")
    keys = list(panel.keys)
    truth = predictions.filter((F.col("fold") < holdout) & F.col("y_true").isNotNull()).groupBy(*keys, panel.ts).agg(F.first("y_true").alias("y_true"))
    moved = over_blocks(truth, panel, lambda b, w: b.withColumn("__d", F.abs(F.col("y_true") - F.lag("y_true", season).over(w))), back=season)
    found = moved.groupBy(*keys).agg(F.count(F.lit(1)).alias("train_rows"), F.avg("__d").alias("scale"))
    return found.select(*keys, F.lit(holdout).alias("fold"), "train_rows", F.when(F.col("scale") > 0, F.col("scale")).alias("scale"))


def score(
    predictions: DataFrame,
    by: Sequence[str],
    metrics: Mapping[str, Metric] = METRICS,
    scale: DataFrame | None = None,
    scale_on: Sequence[str] = (),
    y: str = "y_true",
    yhat: str = "y_pred",
    decimals: int | None = None,
) -> DataFrame:
    """All metrics of one group-by. With ``scale`` (from `mase_scale`) adds MASE.

    A row counts when truth and forecast are both there (``paired_rows``); ``missing_predictions`` are rows
    with a truth and without a forecast. Undefined values are null and ``undefined`` names them, and also
    ``missing_predictions`` where there are some.
    """
    pair, nan = paired(y, yhat), F.isnan(F.col(y).cast("double"))
    out = predictions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("valid_rows"), F.count_if(pair).alias("paired_rows"),
        F.count_if(F.col(y).isNotNull() & ~F.coalesce(nan, F.lit(False)) & ~pair).alias("missing_predictions"),
        *[fn(y, yhat).alias(n) for n, fn in metrics.items()],
    )
    names = list(metrics)
    if scale is not None:
        out = out.join(scale.select(*scale_on, "scale"), list(scale_on), "left")
        out = out.withColumn("MASE", F.col("MAE") / F.col("scale")).drop("scale")
        names.append("MASE")
    out = out.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in names})
    lost = F.when(F.col("missing_predictions") > 0, F.lit("missing_predictions"))
    why = F.concat_ws(",", *[F.when(F.col(n).isNull(), F.lit(n)) for n in names], lost)
    if decimals is not None:
        out = out.withColumns({n: F.round(n, decimals) for n in names})
    return out.withColumn("undefined", why)


def require_defined(scores: DataFrame) -> None:
    """Raise when a score is undefined: no rows, a zero total, a short or constant training series."""
    bad = scores.filter((F.col("undefined") != "") | (F.col("valid_rows") == 0)).limit(20).collect()
    if bad:
        raise PanelError(f"undefined metrics: {[r.asDict() for r in bad]}")
    if scores.isEmpty():
        raise PanelError("nothing to score")


def leaderboard(
    fold_results: DataFrame,
    keys: Sequence[str] = (),
    metrics: Sequence[str] = LEADERBOARD_METRICS,
    decimals: int = 4,
) -> DataFrame:
    """Mean and sample deviation of each metric over folds, best MAE first.

    ``n_folds`` counts a model's folds and ``n_undefined`` those in which some metric is undefined; its means are over
    the others, so a model with any comes after all those without.
    """
    holes = F.col(metrics[0]).isNull()
    for m in metrics[1:]:
        holes = holes | F.col(m).isNull()
    aggs = [
        fn(m).alias(f"{m}_{label}")
        for m in metrics
        for label, fn in (("mean", F.avg), ("std", F.stddev_samp))
    ]
    counts = [F.count(F.lit(1)).alias("n_folds"), F.count_if(holes).alias("n_undefined")]
    out = fold_results.groupBy(*keys, "model").agg(*counts, *aggs)
    rounded = [F.round(c, decimals).alias(c) for c in out.columns if c not in {*keys, "model", "n_folds", "n_undefined"}]
    return out.select(*keys, "model", "n_folds", "n_undefined", *rounded).orderBy(
        *keys, F.col("n_undefined") > 0, F.col(f"{metrics[0]}_mean").asc_nulls_last(), "model"
    )


def with_unscored(results: DataFrame, status: DataFrame, keys: Sequence[str], models: Sequence[str]) -> DataFrame:
    """A leaderboard or fold results with ``reason``, and a row for each series and model that has none there.

    ``status`` is `fold_status` of the same matrix and plan. Such a row has zero counts (folds, rows) and null metrics;
    its reason is that of the status, or that the folds hold no rows.
    """
    every = status.select(*keys, F.col("reason").alias("__why"), F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))
    found = every.join(results.withColumn("__scored", F.lit(True)), [*keys, "model"], "left")
    counts = [c for c in results.columns if c in ("n_folds", "n_undefined", "valid_rows", "paired_rows", "missing_predictions")]
    reason = F.when(F.col("__scored").isNull(), F.coalesce("__why", F.lit("no rows to score")))
    out = found.select(*[F.coalesce(c, F.lit(0)).alias(c) if c in counts else F.col(c) for c in results.columns], reason.alias("reason"))
    if "n_undefined" not in results.columns:
        return out
    # The join loses a leaderboard's order.
    best = next(c for c in results.columns if c.endswith("_mean"))
    return out.orderBy(*keys, F.col("n_undefined") > 0, F.col(best).asc_nulls_last(), "model")


def fold_leaderboard(results: DataFrame, fold: int, order: str = "MAE") -> DataFrame:
    """Every model's results on one fold, best first."""
    return results.filter(F.col("fold") == fold).orderBy(order, "model")


# --- segments -----------------------------------------------------------------

def segments(ts: str) -> Column:
    """The three segment memberships of a row as an array of (segment, value)."""
    parts = {"hour": F.hour(ts), "day_of_week": F.weekday(ts), "month": F.month(ts)}
    return F.array(*[F.struct(F.lit(n).alias("segment"), c.cast("int").alias("segment_value")) for n, c in parts.items()])


def segment_metrics(
    predictions: DataFrame,
    by: Sequence[str] = ("fold", "model"),
    ts: str = "ts",
    metrics: Mapping[str, Metric] = PERCENT_METRICS,
) -> DataFrame:
    """Metrics per hour, weekday and month in long form. Partial sums keep the expansion map-side."""
    long = predictions.withColumn("__s", F.explode(segments(ts))).select("*", "__s.*").drop("__s")
    return long.groupBy("segment", "segment_value", *by).agg(
        *[fn("y_true", "y_pred").alias(n) for n, fn in metrics.items()], F.count(F.lit(1)).alias("n")
    )


def segment_table(predictions: DataFrame, segment: str, ts: str = "ts", by: Sequence[str] = ("model",)) -> DataFrame:
    """MAE with one column per hour, weekday or month."""
    spec = {"hour": (F.hour, range(24)), "dow": (F.weekday, range(7)), "month": (F.month, range(1, 13))}
    if segment not in spec:
        raise PanelError(f"unknown segment {segment!r}")
    fn, values = spec[segment]
    wide = (
        predictions.withColumn("__v", fn(ts))
        .groupBy(*by)
        .pivot("__v", list(values))
        .agg(F.round(mae("y_true", "y_pred"), 4))
    )
    return wide.select(*by, *[F.col(str(v)).alias(f"{segment}_{v}") for v in values])


# --- alignment and significance -------------------------------------------------

def align_models(
    predictions: DataFrame, models: Sequence[str], on: Sequence[str] = ("series_id", "fold", "ts")
) -> DataFrame:
    """One row per key with every model's forecast; keys lacking a model are dropped."""
    wide = (
        predictions.groupBy(*on)
        .pivot("model", list(models))
        .agg(F.avg("y_pred").alias("p"), F.first("y_true", ignorenulls=True).alias("y"))
    )
    truth = F.coalesce(*[F.col(f"`{m}_y`") for m in models])
    return wide.select(*on, truth.alias("y_true"), *[F.col(f"`{m}_p`").alias(m) for m in models]).dropna(
        "any", subset=["y_true", *models]
    )


def dm_matrix(
    predictions: DataFrame,
    models: Sequence[str],
    keys: Sequence[str] = (),
    on: Sequence[str] = ("series_id", "fold", "ts"),
    h: int = 1,
) -> DataFrame:
    """Pairwise Diebold-Mariano test on absolute error, small-sample corrected.

    Every ordered pair is a handful of sums over the aligned table, so all
    pairs share one pass; p-values are added to the few result rows.
    """
    wide = align_models(predictions, models, on)
    err = {m: F.abs(F.col("y_true") - F.col(f"`{m}`")) for m in models}
    pairs = [(a, b) for i, a in enumerate(models) for b in models[i + 1 :]]
    aggs = []
    for i, (a, b) in enumerate(pairs):
        d = err[a] - err[b]
        aggs += [F.avg(d).alias(f"m{i}"), F.var_pop(d).alias(f"v{i}")]
    sums = wide.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *aggs)
    rows = []
    for i, (a, b) in enumerate(pairs):
        for x, y, sign in ((a, b, 1.0), (b, a, -1.0)):
            rows.append(F.struct(
                F.lit(x).alias("model_a"), F.lit(y).alias("model_b"),
                (F.col(f"m{i}") * sign).alias("mean_diff"), F.col(f"v{i}").alias("var_diff"),
            ))
    n = F.col("n")
    correction = F.sqrt((n + 1 - 2 * h + F.lit(h * (h - 1)) / n) / n)
    stat = F.when(F.col("var_diff") <= 0, F.lit(0.0)).otherwise(
        F.col("mean_diff") / F.sqrt(F.col("var_diff") / n) * correction
    )
    out = sums.select(*keys, "n", F.explode(F.array(*rows)).alias("r")).select(*keys, "n", "r.*")
    return out.withColumn("dm", stat).select(*keys, "model_a", "model_b", "n", "mean_diff", "var_diff", "dm")


def dm_p_values(matrix: DataFrame) -> DataFrame:
    """Two-sided p-values from Student's t with n-1 degrees of freedom."""
    p = F.when(F.col("var_diff") <= 0, F.lit(1.0)).otherwise(t_p_value(F.col("dm"), (F.col("n") - 1).cast("double")))
    return matrix.withColumn("p_value", p)


def residual_summary(
    predictions: DataFrame, panel: Panel, by: Sequence[str] = ("fold", "model"), first_rows: int = 168
) -> DataFrame:
    """MAE and RMSE over the first rows of each fold's validation window."""
    keyed = Panel((*panel.keys, *by), panel.ts, panel.freq, panel.unit_rows)
    head = first_n(predictions, keyed, first_rows)
    return score(head, [*panel.keys, *by], {"MAE": METRICS["MAE"], "RMSE": METRICS["RMSE"]}).drop(*CHECKS)


def first_n(df: DataFrame, panel: Panel, n: int, last: bool = False) -> DataFrame:
    """The first (or last) n rows of each group in time order.

    Each chunk keeps its own n rows; only those are numbered per group.
    """
    way = (lambda c: F.col(c).desc()) if last else F.col
    w = Window.partitionBy(*panel.keys, CHUNK).orderBy(way(panel.ts))
    per_chunk = add_chunk(df, panel).withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n)
    sizes = per_chunk.groupBy(*panel.keys, CHUNK).agg(F.count(F.lit(1)).alias("__c"))
    before = Window.partitionBy(*panel.keys).orderBy(way(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*panel.keys, CHUNK, F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__s"))
    starts = starts.filter(F.col("__s") < n)
    return (
        per_chunk.join(starts, [*panel.keys, CHUNK])
        .filter(F.col("__s") + F.col("__n") <= n)
        .drop(CHUNK, "__n", "__s")
    )


def inside_outside(df: DataFrame, keys: Sequence[str], ts: str, value: str, start: Column, end: Column) -> DataFrame:
    """Absolute mean and sample deviation of a residual inside and outside an interval."""
    return (
        df.groupBy(*keys, F.col(ts).between(start, end).alias("inside"))
        .agg(
            F.avg(F.abs(value)).alias("abs_mean"),
            F.stddev_samp(value).alias("std"),
            F.count(value).alias("n"),
        )
    )


def compare_runs(a: DataFrame, b: DataFrame, on: Sequence[str], metric_name: str = "MAE") -> DataFrame:
    """Two result tables side by side with the difference and its percentage."""
    left = a.select(*on, F.col(metric_name).alias(f"{metric_name}_base"))
    right = b.select(*on, F.col(metric_name).alias(f"{metric_name}_other"))
    delta = F.col(f"{metric_name}_other") - F.col(f"{metric_name}_base")
    return left.join(right, list(on)).withColumn("delta", delta).withColumn(
        "delta_pct", F.try_divide(delta * 100, F.col(f"{metric_name}_base"))
    )


def mean_importance(importances: DataFrame) -> DataFrame:
    """Mean importance per feature over folds, with its rank."""
    # One row per feature: the ranking window is as small as the feature list.
    mean = importances.groupBy("feature").agg(F.avg("importance").alias("importance_mean"))
    by_gain = Window.orderBy(F.col("importance_mean").desc(), "feature")
    return mean.withColumn("rank", F.row_number().over(by_gain))

