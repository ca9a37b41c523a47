import pytest
from pyspark.sql import functions as F

from chronopanel.operators import features, forecast
from chronopanel.panel import Panel
from chronopanel.plans import folds as fp
from tests.helpers import seasonal_values, series

P = Panel(keys=("series_id",), freq="1h")


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def inputs(spark):
    matrix = features.build_features(series(spark, seasonal_values(24 * 50)), P, "y", (1, 24), (3,)).cache()
    return matrix, fp.fold_plan(matrix, P, 3, 30, 4).cache()


def test_a_broken_run_is_taken_up(spark, inputs, tmp_path, monkeypatch):
    matrix, folds = inputs
    models = [forecast.NaiveLag("y_lag_1h", "naive"), forecast.BoostedTrees(trees=4, depth=3)]
    straight = forecast.backtest(matrix, P, "y", folds, models)
    folder, calls, real = str(tmp_path / "run"), [], forecast.backtest
    go = lambda **more: forecast.resumable_backtest(matrix, P, "y", folds, more.pop("models", models), folder, **more)

    def counted(m, p, t, f, ms, **options):
        calls.append((ms[0].name, sorted(r["fold"] for r in f.select("fold").distinct().collect())))
        return real(m, p, t, f, ms, **options)

    monkeypatch.setattr(forecast, "backtest", counted)
    assert go(max_fits=4) is None and calls == [("naive", [1, 2, 3]), ("gradient_boosted_trees", [1])]
    # Files of a fold that was not committed are replaced.
    spark.range(3).write.parquet(f"{folder}/predictions/model=gradient_boosted_trees/fold=2")
    run = go()
    assert calls[2:] == [("gradient_boosted_trees", [2, 3])]
    assert rows(run.predictions) == rows(straight.predictions) and rows(run.importances) == rows(straight.importances)
    assert rows(run.nodes) == rows(straight.nodes) and {(r["model"], r["fold"]) for r in run.fits.collect()} == {("gradient_boosted_trees", k) for k in (1, 2, 3)}
    again = go()
    assert len(calls) == 3 and rows(again.predictions) == rows(straight.predictions)
    # Other parameters or another plan count as not done.
    go(models=[models[0], forecast.BoostedTrees(trees=3, depth=3)])
    assert calls[3:] == [("gradient_boosted_trees", [1, 2, 3])]
    moved = folds.withColumn("valid_end", F.when(F.col("fold") == 2, F.expr("valid_end - interval 1 hour")).otherwise(F.col("valid_end")))
    forecast.resumable_backtest(matrix, P, "y", moved, models[:1], folder)
    assert calls[4:] == [("naive", [2])]
