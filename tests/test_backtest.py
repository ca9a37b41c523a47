"""Folds, metrics, comparison, forecasters."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopanel import Panel, PanelError
from chronopanel.functions import special
from chronopanel.functions.metrics import METRICS, metric
from chronopanel.operators import arima, ensemble, evaluate, features, forecast
from chronopanel.plans import folds as fp
from chronopanel.plans import units
from tests.helpers import column, seasonal_values, series, union

P = Panel()


def pairs(spark, y, p):
    return spark.createDataFrame(list(zip(map(float, y), map(float, p))), "y_true double, y_pred double")


@pytest.mark.parametrize("name, y, p, want", [
    ("MAE", [10, 20], [12, 17], 2.5),
    ("RMSE", [10, 20], [12, 17], 6.5**0.5),
    ("WAPE", [10], [12], 0.2),
    ("WAPE", [10, 20], [12, 17], 5 / 30),
    ("sMAPE", [0, 0, 0], [0, 0, 0], 0.0),
    ("sMAPE", [10], [8], 2 / 9),
    ("MAPE", [10, 0], [12, 0], 10.0),
])
def test_metric_values(spark, name, y, p, want):
    assert pairs(spark, y, p).agg(metric(name)("y_true", "y_pred")).first()[0] == pytest.approx(want, abs=1e-12)


def test_metrics_on_random_pairs(spark):
    rng = np.random.default_rng(42)
    y = rng.uniform(0, 5, 1000)
    p = y + rng.normal(0, 0.3, 1000)
    row = evaluate.score(pairs(spark, y, p), []).first()
    assert row.MAE == pytest.approx(np.abs(y - p).mean())
    assert row.RMSE == pytest.approx(np.sqrt(((y - p) ** 2).mean()))


def test_undefined_metrics(spark):
    zero = evaluate.score(pairs(spark, [0, 0], [1, 1]), [])
    assert zero.first().WAPE is None and zero.first().undefined == "WAPE"
    with pytest.raises(PanelError):
        evaluate.require_defined(zero)
    with pytest.raises(PanelError):
        evaluate.require_defined(evaluate.score(pairs(spark, [1], [1]).filter("y_true > 5"), []))
    with pytest.raises(KeyError):
        metric("nope")


def one_fold(spark, train, start=datetime(2008, 1, 1)):
    n = len(train)
    t = lambda i: start + timedelta(hours=i)
    plan = [("a", 1, t(0), t(n - 1), t(n), t(n + 1))]
    return spark.createDataFrame(
        plan, "series_id string, fold int, train_start timestamp_ntz, train_end timestamp_ntz, valid_start timestamp_ntz, valid_end timestamp_ntz"
    )


def test_mase(spark):
    df = series(spark, [1.0, 2.0, 3.0, 4.0, 5.0, 10.0, 20.0])
    scale = evaluate.mase_scale(df, P, "y", one_fold(spark, [1] * 5), season=1)
    assert scale.first().scale == 1.0
    preds = pairs(spark, [10, 20], [12, 17]).withColumns({"series_id": F.lit("a"), "fold": F.lit(1)})
    assert evaluate.score(preds, ["series_id", "fold"], scale=scale, scale_on=["series_id", "fold"]).first().MASE == 2.5
    for values, season in (([3.0] * 7, 1), ([1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0], 5)):
        assert evaluate.mase_scale(series(spark, values), P, "y", one_fold(spark, [1] * 5), season=season).first().scale is None


def long_index(spark):
    n = 731 * 24
    return spark.range(n).select(
        F.lit("a").alias("series_id"), (F.lit(1199145600) + F.col("id") * 3600).alias("s")
    ).select("series_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"))


def test_fold_invariants(spark):
    idx = long_index(spark)
    rows = fp.fold_plan(idx, P).orderBy("fold").collect()
    assert len(rows) == 6 and [r.fold for r in rows] == list(range(1, 7))
    assert rows[-1].valid_end == datetime(2009, 12, 31, 23)
    for a, b in zip(rows, rows[1:]):
        assert a.valid_end < b.valid_start
    for r in rows:
        assert r.train_end < r.valid_start
        assert r.valid_start - r.train_end == timedelta(hours=1)
        assert r.valid_end - r.valid_start == timedelta(days=30) - timedelta(hours=1)
        assert r.train_end - r.train_start == timedelta(days=365) - timedelta(hours=1)
    gap = fp.fold_plan(idx, P, gap_days=2).orderBy("fold").collect()
    assert all(r.valid_start - r.train_end == timedelta(days=2, hours=1) for r in gap)
    table = fp.fold_table(idx, P, fp.fold_plan(idx, P)).orderBy("fold").collect()
    assert all(t.valid_rows == 720 and t.train_rows == 8760 and t.valid_completeness == 1.0 for t in table)


def test_short_series(spark):
    short = series(spark, [1.0] * 240)
    with pytest.raises(Exception, match="spans less than"):
        fp.fold_plan(short, P).collect()
    assert fp.fold_plan(short, P, strict=False).count() == 0
    with pytest.raises(PanelError):
        fp.fold_plan(short, P, n_folds=0)


def test_short_series_come_out_of_leaderboard_and_fold_results(spark):
    df = union(series(spark, seasonal_values(24 * 20)), series(spark, seasonal_values(24 * 5, 1), name="short"))
    matrix = df.withColumn("p", F.col("y") + 1)
    plan = {"n_folds": 3, "train_days": 6, "valid_days": 2}
    preds = forecast.naive_predictions(matrix, P, "y", fp.fold_plan(matrix, P, **plan, strict=False), [forecast.NaiveLag("p", "m")])
    scores = evaluate.score(preds, ["series_id", "fold", "model"])
    gone = series(spark, [1.0], name="no rows")
    status = fp.fold_status(matrix, P, **plan, series=union(df, gone))
    board = {r.series_id: r for r in evaluate.with_unscored(evaluate.leaderboard(scores, ["series_id"], ["MAE"]), status, ["series_id"], ["m"]).collect()}
    assert len(board) == 3 and board["no rows"].reason == board["short"].reason == "series too short"
    assert all(board[s].n_folds == 0 and board[s].model == "m" and board[s].MAE_mean is None for s in ("short", "no rows"))
    (whole,) = [r for s, r in board.items() if s not in ("short", "no rows")]
    assert whole.n_folds == 3 and whole.reason is None and abs(whole.MAE_mean - 1) < 1e-6
    out = evaluate.with_unscored(scores, status, ["series_id"], ["m"]).collect()
    assert len(out) == 5 and {r.series_id for r in out if r.valid_rows == 0 and r.reason} == {"short", "no rows"}


def test_fold_assignment_beyond_the_broadcast_bound(spark, monkeypatch):
    df = union(series(spark, seasonal_values(24 * 20)), series(spark, seasonal_values(24 * 16, 1), name="b"))
    plan = fp.fold_plan(df, P, 3, 6, 2)
    key = lambda d: sorted(map(tuple, d.select("series_id", "ts", "fold", "role").collect()))
    small = key(fp.assign_folds(df, P, plan))
    monkeypatch.setattr(units, "BROADCAST_ROWS", 0)
    assert key(fp.assign_folds(df, Panel(unit_rows=50), plan)) == small
    stats = df.groupBy("series_id").agg(F.avg("y").alias("m"))
    assert units.attach(df, Panel(unit_rows=50), stats).count() == df.count()


def test_naive_forecasts_equal_the_lag_column(spark):
    start = datetime(2010, 1, 1)
    df = series(spark, [float(i) for i in range(1, 11)], start=start).withColumn("y_lag_1h", F.col("y") - 1)
    model = forecast.NaiveLag("y_lag_1h", "n").fit(df, "y", [])
    assert column(model.predict(df), "y_pred") == [float(i) for i in range(10)]
    assert model.get_hyperparameters() == {"column": "y_lag_1h"}
    with pytest.raises(PanelError):
        forecast.NaiveLag("absent", "n").predict(df)


# Published fold results of two models and their leaderboard rows.
FOLD_MAE = {"m1": [0.4, 0.3, 0.35, 0.45, 0.25, 0.3], "m2": [0.5, 0.4, 0.45, 0.6, 0.3, 0.35]}


def test_leaderboard_mean_and_sample_deviation(spark):
    rows = [(m, i, v) for m, vs in FOLD_MAE.items() for i, v in enumerate(vs, 1)]
    df = spark.createDataFrame(rows, "model string, fold int, MAE double")
    out = evaluate.leaderboard(df, metrics=["MAE"]).collect()
    assert [r.model for r in out] == ["m1", "m2"]
    assert out[0].MAE_mean == round(float(np.mean(FOLD_MAE["m1"])), 4)
    assert out[0].MAE_std == round(float(np.std(FOLD_MAE["m1"], ddof=1)), 4)


def predictions(spark, n=200, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = 1 + rng.random()
        t = datetime(2010, 1, 1) + timedelta(hours=i)
        for m, s in (("a", 0.1), ("b", 0.3)):
            rows.append(("s", 1 + i * 4 // n, t, m, y, y + rng.gauss(0, s)))
    return spark.createDataFrame(rows, "series_id string, fold int, ts timestamp_ntz, model string, y_true double, y_pred double")


def test_diebold_mariano(spark):
    p = predictions(spark)
    wide = p.groupBy("ts").pivot("model", ["a", "b"]).agg(F.first(F.abs(F.col("y_true") - F.col("y_pred")))).toPandas()
    d = (wide.a - wide.b).to_numpy()
    want = d.mean() / np.sqrt(d.var() / len(d)) * np.sqrt((len(d) - 1) / len(d))
    out = {(r.model_a, r.model_b): r for r in evaluate.dm_p_values(evaluate.dm_matrix(p, ["a", "b"])).collect()}
    assert out[("a", "b")].dm == pytest.approx(want) and out[("b", "a")].dm == pytest.approx(-want)
    assert 0 <= out[("a", "b")].p_value < 1e-6
    twins = p.filter("model = 'a'").unionByName(p.filter("model = 'a'").withColumn("model", F.lit("b")))
    tie = evaluate.dm_p_values(evaluate.dm_matrix(twins, ["a", "b"])).first()
    assert tie.dm == 0.0 and tie.p_value == 1.0


def test_t_distribution_tail():
    # Fixed values from t tables: P(|T| >= 2.228) = 0.05 with 10 degrees, 1.96 at large n.
    assert special.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert special.t_two_sided(12.7062, 1) == pytest.approx(0.05, abs=1e-5)
    assert special.t_two_sided(1.959964, 1e7) == pytest.approx(0.05, abs=1e-5)
    assert special.t_two_sided(0.0, 5) == pytest.approx(1.0)


def test_stacking_is_closed_form_ridge(spark):
    p = predictions(spark)
    out, fitted = ensemble.stack(p, ["a", "b"], holdout=4)
    wide = p.groupBy("fold", "ts", "y_true").pivot("model", ["a", "b"]).agg(F.first("y_pred")).toPandas()
    tr = wide[wide.fold < 4]
    x, y = tr[["a", "b"]].to_numpy(), tr.y_true.to_numpy()
    xc = x - x.mean(0)
    w = np.linalg.solve(xc.T @ xc + np.eye(2), xc.T @ (y - y.mean()))
    assert np.allclose(fitted.weights, w) and fitted.intercept == pytest.approx(y.mean() - w @ x.mean(0))
    assert out.count() == 50 and out.filter("y_pred < 0").count() == 0


def test_first_and_last_rows(spark):
    df = union(series(spark, [float(i) for i in range(50)]), series(spark, [1.0, 2.0], name="b"))
    assert column(evaluate.first_n(df, Panel(unit_rows=3), 5), "y") == [0.0, 1, 2, 3, 4, 1, 2]
    assert column(evaluate.first_n(df, Panel(unit_rows=3), 2, last=True), "y") == [48.0, 49, 1, 2]


@pytest.fixture(scope="module")
def seasonal(spark):
    df = series(spark, seasonal_values(24 * 60))
    matrix = features.build_features(df, P, "y", (1, 24), (3, 24)).cache()
    return df, matrix, fp.fold_plan(matrix, P, 2, 30, 5)


def test_trees_beat_the_naive_forecast(seasonal):
    _, matrix, folds = seasonal
    models = [forecast.NaiveLag("y_lag_1h", "naive"), forecast.BoostedTrees(trees=15, depth=4, bins=32, step=0.2), forecast.Forest(trees=10, depth=6)]
    run = forecast.backtest(matrix, P, "y", folds, models)
    mae = {r.model: r.MAE for r in evaluate.score(run.predictions, ["model"], METRICS).collect()}
    assert mae["gradient_boosted_trees"] < mae["naive"] and mae["random_forest"] < mae["naive"]
    assert run.fits.count() == 4
    top = evaluate.mean_importance(run.importances).orderBy("rank").collect()
    assert top[0].importance_mean >= top[-1].importance_mean and top[0].rank == 1
    with pytest.raises(PanelError):
        models[1].fit(matrix, "y", ["hour"]).predict(matrix.drop("hour"))


class Asked(Exception):
    pass


@pytest.mark.parametrize("name,size", [("m4_boosted_trees", (500, 6)), ("m5_trees_with_exogenous", (500, 6)), ("m6_random_forest", (250, 16)), ("a23_feature_importance", (500, 6))])
def test_tree_queries_run_at_full_size(spark, monkeypatch, name, size):
    from chronopanel.queries import backtests
    from chronopanel.queries.base import QUERIES

    def asked(matrix, panel, target, folds, models):
        raise Asked(matrix.columns, folds.groupBy("series_id").count().collect(), models)

    monkeypatch.setattr(backtests.forecast, "backtest", asked)
    with pytest.raises(Asked) as seen:
        QUERIES[name](spark, "/root/testdata/sf0.01")
    columns, folds, (model,) = seen.value.args
    default = forecast.Forest() if name == "m6_random_forest" else forecast.BoostedTrees()
    assert model.get_hyperparameters() == default.get_hyperparameters() and (model.trees, model.depth) == size
    assert folds and all(r["count"] == 6 for r in folds)
    assert name == "m5_trees_with_exogenous" or {"value_lag_1h", "value_lag_24h", "value_lag_168h"} <= set(columns)


def test_arima_against_numpy(spark):
    rng = np.random.default_rng(1)
    e = rng.normal(size=1500)
    y = np.cumsum(e)
    model = arima.SeasonalArima((1, 1, 0), (0, 0, 0, 6))
    df = series(spark, [float(v) for v in y])
    folds = fp.fold_plan(df, P, 1, 40, 10)
    got = model.predictions(df, Panel(unit_rows=300), "y", folds).orderBy("ts").collect()
    plan = folds.first()
    d = np.diff(y, prepend=np.nan)
    at = lambda t: int((t - datetime(2008, 1, 1)).total_seconds() // 3600)
    tr = np.arange(max(at(plan.train_start), model.reach), at(plan.train_end) + 1)
    x = np.column_stack([d[tr - 1], np.ones(len(tr))])
    b = np.linalg.lstsq(x, d[tr], rcond=None)[0]
    va = np.arange(at(plan.valid_start), at(plan.valid_end) + 1)
    want = y[va - 1] + b[0] * d[va - 1] + b[1]
    assert len(got) == len(va) and np.allclose([r.y_pred for r in got], want, atol=1e-6)
    path = model.forecast_path(df, P, "y", folds, 3).orderBy("h").collect()
    last, dl = y[at(plan.train_end)], d[at(plan.train_end)]
    steps = []
    for _ in range(3):
        dl = b[0] * dl + b[1]
        last += dl
        steps.append(last)
    assert np.allclose([r.y_pred for r in path], steps, atol=1e-6)


def test_seasonal_arima_beats_the_naive_forecast(seasonal):
    df, matrix, folds = seasonal
    preds = arima.SeasonalArima().predictions(df, P, "y", folds)
    naive = forecast.naive_predictions(matrix, P, "y", folds, [forecast.NaiveLag("y_lag_1h", "naive")])
    mae = {r.model: r.MAE for r in evaluate.score(preds.unionByName(naive), ["model"]).collect()}
    assert mae["seasonal_arima"] < mae["naive"]
    terms = {r.term for r in arima.SeasonalArima().coefficients(df, P, "y", folds).collect()}
    assert terms == {"ar_1", "ar_24", "ar_25", "ma_1", "ma_24", "ma_25", "constant"}


def test_arima_takes_outside_columns(seasonal):
    df, _, folds = seasonal
    with_x = df.withColumn("x", F.sin(F.hour("ts") / 3.0))
    model = arima.SeasonalArima((1, 1, 0), (0, 1, 0, 24), exog=("x",))
    assert model.predictions(with_x.withColumn("x", F.col("x") + F.rand(3)), P, "y", folds).count() == 240
    with pytest.raises(PanelError):
        model.predictions(df, P, "y", folds)


def test_only_plan_nodes_tell_whether_a_table_is_stored(spark):
    from chronopanel.plans.units import is_stored

    df = series(spark, [1.0, 2.0])
    assert is_stored(df.withColumn("Join", F.lit("Sort Window")).filter("y > 1"))
    assert not is_stored(df.orderBy("ts").select("ts")) and not is_stored(df.join(df.select("ts"), "ts")) and not is_stored(df.distinct())
