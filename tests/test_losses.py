"""Nothing is lost or changed without a word: gaps, NaN, short series, missing forecasts, files, storage."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopanel.functions.special import t_two_sided
from chronopanel.operators import arima, evaluate, features, forecast, impute, quality
from chronopanel.operators.quantiles import exact_quantiles
from chronopanel.panel import Panel, PanelError
from chronopanel.plans import folds as fp
from chronopanel.plans import units
from chronopanel.session import new_folder, stored
from chronopanel.sources.observations import read_text

P = Panel()
NAN = float("nan")
T0 = datetime(2008, 1, 1)


def series(spark, values, name="a"):
    rows = [(name, T0 + timedelta(hours=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, y double")


def test_nan_is_missing(spark):
    df = series(spark, [1.0, NAN, 2.0])
    out = impute.fill_gaps(df, P, ["y"]).orderBy("ts").collect()
    assert [r.y for r in out] == [1.0, 1.0, 2.0] and [r.is_originally_missing for r in out] == [0, 1, 0]
    assert [r.length for r in quality.gap_summary(df, P, ["y"]).collect()] == [1]
    assert [r.gap_length for r in quality.gap_lengths(df, P, ["y"]).orderBy("ts").collect()] == [0, 1, 0]
    assert quality.missing_rows(df, ["series_id"], ["y"]).first().rows_any_missing == 1
    assert exact_quantiles(series(spark, [1.0, NAN, 3.0]), ["series_id"], "y", [0.5]).first()["quantile"] == 2.0
    audit = quality.column_audit(df, ["y", "series_id"]).orderBy("column_name").collect()
    assert [(r.column_name, r.n_unique, r.max) for r in audit] == [("series_id", 1, None), ("y", 2, 2.0)]
    assert audit[1].missing_pct == pytest.approx(100 / 3)


def test_audit_keeps_long_integers_apart(spark):
    df = spark.createDataFrame([(2**53,), (2**53 + 1,)], "n bigint")
    assert quality.column_audit(df, ["n"]).first().n_unique == 2


def test_scores_use_complete_pairs(spark):
    rows = [("m", 10.0, 11.0), ("m", 10.0, None), ("n", 10.0, 11.0), ("n", 10.0, NAN), ("o", 10.0, 11.0), ("o", None, 3.0)]
    out = {r.model: r for r in evaluate.score(spark.createDataFrame(rows, "model string, y_true double, y_pred double"), ["model"]).collect()}
    for m in "mn":
        assert (out[m].MAE, out[m].WAPE, out[m].valid_rows, out[m].paired_rows, out[m].missing_predictions) == (1.0, 0.1, 2, 1, 1)
        assert out[m].undefined == "missing_predictions"
    assert (out["o"].MAE, out["o"].paired_rows, out["o"].missing_predictions, out["o"].undefined) == (1.0, 1, 0, "")
    with pytest.raises(PanelError):
        evaluate.require_defined(evaluate.score(spark.createDataFrame(rows[2:4], "model string, y_true double, y_pred double"), ["model"]))


def test_leaderboard_tells_undefined_folds(spark):
    rows = [("bad", 1, None), ("bad", 2, 0.1), ("good", 1, 1.0), ("good", 2, 1.0)]
    board = evaluate.leaderboard(spark.createDataFrame(rows, "model string, fold int, MAE double"), metrics=["MAE"]).collect()
    assert [(r.model, r.n_folds, r.n_undefined) for r in board] == [("good", 2, 0), ("bad", 2, 1)]


def test_short_series_are_named(spark):
    df = series(spark, [1.0] * 100).union(series(spark, [1.0] * 24 * 20, "b"))
    out = {r.series_id: r for r in fp.fold_status(df, P, 2, 10, 3).collect()}
    assert (out["a"].n_folds, out["a"].reason, out["b"].n_folds, out["b"].reason) == (0, "series too short", 2, None)
    assert set(out) - {r.series_id for r in fp.fold_plan(df, P, 2, 10, 3, strict=False).collect()} == {"a"}


def test_seasonal_path_is_complete(spark):
    df = series(spark, [float(i) for i in range(48)]).filter(F.hour("ts") != 5)
    origin = df.groupBy("series_id").agg(F.max("ts").alias("origin"))
    out = forecast.seasonal_naive_path(df, P, "y", origin, 48, 24).orderBy("h").collect()
    assert len(out) == 48
    assert [r.h for r in out if r.y_pred is None] == [r.h for r in out if r.reason] == [6, 30]


def cycle(n=1500, holes=()):
    y = [10 + 3 * math.sin(2 * math.pi * i / 24) + 0.5 * math.sin(i / 7) for i in range(n)]
    return [None if n - 1 - i in holes else v for i, v in enumerate(y)]


@pytest.mark.parametrize("before,reason", [(6, None), (121, None), (2, "missing values"), (0, "missing values")])
def test_arima_path_and_holes(spark, before, reason):
    """A hole ``before`` rows ahead of the last training row; the model looks back on rows 1 to 3 and around 24 and 48."""
    model = arima.SeasonalArima((1, 1, 0), (0, 0, 0, 24))
    folds = fp.fold_plan(series(spark, cycle()), P, 1, 40, 10)
    end = folds.first().train_end
    at = int((end - T0).total_seconds() // 3600)
    values = cycle()
    values[at - before] = None
    out = model.forecast_path(series(spark, values), P, "y", folds, 24).orderBy("h").collect()
    assert [r.h for r in out] == list(range(1, 25)) and out[0].ts == end + timedelta(hours=1)
    if reason:
        assert all(r.y_pred is None and r.reason.startswith(reason) for r in out)
    else:
        assert all(r.reason is None for r in out) and abs(out[0].y_pred - cycle()[at + 1]) < 0.5


def test_arima_path_without_last_row(spark):
    folds = fp.fold_plan(series(spark, cycle()), P, 1, 40, 10)
    df = series(spark, cycle()).filter(F.col("ts") != F.lit(folds.first().train_end))
    out = arima.SeasonalArima((1, 1, 0), (0, 0, 0, 24)).forecast_path(df, P, "y", folds, 3).collect()
    assert [r.reason for r in out] == ["no row at the end of the training window"] * 3


def test_too_few_rows_to_fit(spark):
    rows = [("a", float(i), float(i)) for i in range(2)] + [("b", float(i * i), 2.0 * i * i + 1) for i in range(9)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    out = arima.least_squares(df, ["k"], [F.col("x")], F.col("y"), "w").collect()
    assert [r.k for r in out] == ["b"] and np.allclose(out[0].w, [2, 1], atol=1e-6)


def test_validation_counts_per_series(spark):
    df = series(spark, [1.0] * 100).union(series(spark, [1.0] * 3, "b")).withColumn("d", F.col("y").cast("decimal(10,2)"))
    report = {r.check_name: r.failed_rows for r in quality.validate(df, P, ["y", "d"], min_rows=50).collect()}
    assert report["row_sufficiency"] == 47 and report["non_numeric_columns"] == 0


def test_files_with_other_column_order_are_refused(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Date;Time;v\n1/1/2008;00:00:00;1\n")
    (tmp_path / "b.txt").write_text("Date;v;Time\n1/1/2008;2;00:00:00\n")
    assert read_text(spark, str(tmp_path / "a.txt")).count() == 1
    with pytest.raises(Exception, match="(?i)header"):
        read_text(spark, str(tmp_path)).collect()


def test_sequences_scaled_by_training_rows(spark):
    df = series(spark, [float(i) for i in range(24 * 30)])
    folds = fp.fold_plan(df, P, 2, 10, 3)
    stats = features.training_stats(df, P, "y", folds, 1)
    plan = folds.filter("fold = 1").first()
    lo, hi = (int((t - T0).total_seconds() // 3600) for t in (plan.train_start, plan.train_end))
    assert stats.first().train_mean == pytest.approx((lo + hi) / 2)
    out = features.sequence_samples(df.withColumn("y", F.when(F.col("y") != 700, F.col("y"))), P, "y", 24, stats)
    assert out.filter("next_value IS NULL").count() == 0 and out.agg(F.max("next_value")).first()[0] > 1.8


def test_p_value_at_large_n():
    assert t_two_sided(1.959963985, 1e13) == pytest.approx(0.05, abs=1e-8)
    assert t_two_sided(1.96, 0.9e8) == pytest.approx(t_two_sided(1.96, 1.1e8), abs=1e-8)


def test_broadcast_is_bounded_in_bytes(spark, monkeypatch):
    wide = spark.range(100).withColumn("text", F.repeat(F.lit("x"), 1000))
    assert units.broadcast_if_small(wide) is not None
    monkeypatch.setattr(units, "BROADCAST_BYTES", 50_000)
    assert units.broadcast_if_small(wide) is None


def test_stored_block_leaves_nothing(spark, tmp_path):
    from chronopanel.session import keep, materialize

    jsc = spark.sparkContext._jsc.sc()
    before = jsc.getPersistentRDDs().size()
    with stored(spark):
        folder = new_folder(spark, "probe")
        table = materialize(spark.range(5))
        kept = keep(spark.range(7))
        assert kept.count() == 7 and table.count() == 5
        spark.range(1).write.parquet(folder)
        files = [f for df in (table,) for f in df.inputFiles()]
    assert jsc.getPersistentRDDs().size() == before
    with pytest.raises(Exception):
        spark.read.parquet(folder).count()
    with pytest.raises(Exception):
        spark.read.parquet(files[0]).count()


def test_series_number_and_fold_results(spark):
    df = series(spark, cycle(24 * 40)).union(series(spark, [v * 9 for v in cycle(24 * 40)], "b"))
    matrix = features.build_features(df, P, "y", (1, 24), (), calendar=False, cyclical=False, holidays=False)
    folds = fp.fold_plan(matrix, P, 2, 20, 3)
    run = forecast.backtest(matrix, P, "y", folds, [forecast.BoostedTrees(trees=3, depth=3, bins=16), *forecast.naive_baselines("y")[:1]])
    scores = evaluate.score(run.predictions, ["fold", "model"])
    rows = run.fold_results(scores).collect()
    assert len(rows) == 4 and all((r.fit_seconds is None) == (r.model == "naive_lag_1h") for r in rows)
    assert {r.feature for r in run.importances.collect()} == {"y_lag_1h", "y_lag_24h", forecast.SERIES}


def test_verdict_needs_both_tests(spark):
    from chronopanel.operators.dependence import stationarity

    rng = np.random.default_rng(3)
    df = series(spark, [5.0] * 200).union(series(spark, [float(v) for v in rng.normal(size=20)], "short")).union(
        series(spark, [float(v) for v in rng.normal(size=400)], "noise")).union(series(spark, [None] * 5, "none"))
    out = {r.series_id: (r.verdict, r.reason) for r in stationarity(df, P, "y", 10).collect()}
    assert out["noise"] == ("stationary", None)
    assert out["short"] == (None, "too few rows for 10 lags")
    assert out["a"] == out["none"] == (None, "constant or without values")
