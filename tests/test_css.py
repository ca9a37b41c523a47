import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopanel.operators.css import CssArima
from chronopanel.panel import Panel, PanelError
from chronopanel.plans import folds as fp
from tests.helpers import same, series, union

P = Panel(keys=("series_id",), freq="1h")


def simulated(n, ar, sar, ma, sma, s=24, seed=0):
    """(1, 1, 1) x (1, 1, 1, s), by hand."""
    rng = np.random.default_rng(seed)
    e, w = rng.normal(size=n), np.zeros(n)
    at = lambda v, t: v[t] if t >= 0 else 0.0
    for t in range(n):
        w[t] = (ar * at(w, t - 1) + sar * at(w, t - s) - ar * sar * at(w, t - s - 1)
                + e[t] + ma * at(e, t - 1) + sma * at(e, t - s) + ma * sma * at(e, t - s - 1))
    y = np.zeros(n)
    for t in range(n):
        y[t] = w[t] + at(y, t - 1) + at(y, t - s) - at(y, t - s - 1)
    return y


@pytest.fixture(scope="module")
def two(spark):
    df = union(series(spark, simulated(24 * 95, 0.5, 0.3, -0.4, -0.6).tolist()), series(spark, simulated(24 * 95, -0.4, 0.5, -0.5, 0.3, seed=7).tolist(), name="b")).cache()
    return df, fp.fold_plan(df, P, 1, 90, 4).cache()


def test_simulated_weights_are_met(two):
    df, folds = two
    got = {(r["series_id"], r["term"]): r["coefficient"] for r in CssArima().coefficients(df, P, "y", folds).collect()}
    want = {("a", "ar_1"): 0.5, ("a", "ar_24"): 0.3, ("a", "ma_1"): -0.4, ("a", "ma_24"): -0.6, ("b", "ar_1"): -0.4, ("b", "ar_24"): 0.5, ("b", "ma_1"): -0.5, ("b", "ma_24"): 0.3}
    # 2,160 rows: the larger deviations of the estimates themselves are near 0.07.
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 0.12, got


def test_long_series_meets_the_weights(spark):
    df = series(spark, simulated(24 * 500, 0.5, 0.3, -0.4, -0.6, seed=2).tolist())
    folds = fp.fold_plan(df, P, 1, 490, 5)
    got = {r["term"]: r["coefficient"] for r in CssArima().coefficients(df, Panel(unit_rows=20_000), "y", folds).collect()}
    assert max(abs(got[k] - v) for k, v in {"ar_1": 0.5, "ar_24": 0.3, "ma_1": -0.4, "ma_24": -0.6}.items()) < 0.05, got


def test_blocks_change_nothing(two):
    df, folds = two
    holes = df.withColumn("y", F.when(F.pmod(F.xxhash64("ts", "series_id"), F.lit(400)) != 0, F.col("y")))
    model = CssArima(rounds=8)
    one, many = (model.predictions(holes, Panel(unit_rows=u), "y", folds).select("series_id", "ts", "y_true", "y_pred") for u in (8192, 300))
    same(one, many, tol=1e-4)
    weights = dict(zip(model.terms, [0.4, 0.2, -0.5, -0.3]))
    e = [model.innovations(holes, Panel(unit_rows=u), "y", folds, weights).drop("fold", "whole") for u in (8192, 64)]
    same(*e, tol=1e-9)


def test_innovations_by_hand(spark):
    y = [3.0, 5.0, 4.0, None, 7.0, 6.0, 8.0] + [float(i % 5) for i in range(24 * 3)]
    df = series(spark, y)
    folds = fp.fold_plan(df, P, 1, 1, 1)
    folds = folds.withColumn("train_start", F.lit("2008-01-01").cast("timestamp_ntz"))
    model = CssArima((0, 0, 1), (0, 0, 0, 24))
    got = [r["e"] for r in model.innovations(df, P, "y", folds, {"ma_1": 0.5}).orderBy("at").limit(7).collect()]
    assert got == pytest.approx([3.0, 3.5, 2.25, 0.0, 7.0, 2.5, 6.75])
    with pytest.raises(PanelError):
        model.innovations(df, P, "y", folds, {})


def test_path_repeats_the_recurrence(two):
    df, folds = two
    model = CssArima((1, 1, 1), (0, 0, 0, 24), rounds=10)
    w = {r["term"]: r["coefficient"] for r in model.coefficients(df, P, "y", folds).filter("series_id = 'a'").collect()}
    path = model.forecast_path(df, P, "y", folds, 3).filter("series_id = 'a'").orderBy("h").collect()
    e = model.innovations(df, P, "y", folds, w).filter("series_id = 'a'").join(folds.select("series_id", "train_end"), "series_id").filter("ts = train_end").first()["e"]
    end = folds.filter("series_id = 'a'").first()["train_end"]
    y = [r["y"] for r in df.filter((F.col("series_id") == "a") & (F.col("ts") <= F.lit(end))).orderBy(F.desc("ts")).limit(2).collect()][::-1]
    z = w["ar_1"] * (y[1] - y[0]) + w["ma_1"] * e
    want = [y[1] + z]
    for _ in range(2):
        z *= w["ar_1"]
        want.append(want[-1] + z)
    assert [r["y_pred"] for r in path] == pytest.approx(want) and all(r["reason"] is None for r in path)


def test_outside_column_and_short_windows(spark):
    rng = np.random.default_rng(5)
    x, e = rng.normal(size=24 * 40), 0.1 * rng.normal(size=24 * 40)
    y = np.cumsum(2.5 * np.diff(x, prepend=0) + e + 0.4 * np.concatenate(([0], e[:-1])))
    df = series(spark, y.tolist()).withColumn("i", (F.unix_seconds(F.col("ts").cast("timestamp")) - 1199145600) / 3600)
    xs = spark.createDataFrame([(float(i), float(v)) for i, v in enumerate(x)], "i double, outside double")
    df = df.join(xs, "i").drop("i").cache()
    folds = fp.fold_plan(df, P, 1, 30, 5)
    model = CssArima((0, 1, 1), (0, 0, 0, 24), exog=("outside",))
    got = {r["term"]: r["coefficient"] for r in model.coefficients(df, P, "y", folds).collect()}
    assert got["outside"] == pytest.approx(2.5, abs=0.02) and got["ma_1"] == pytest.approx(0.4, abs=0.12)
    path = model.forecast_path(df, P, "y", folds, 24 * 5 + 2).orderBy("h").collect()
    assert [r["reason"] for r in path[-3:]] == [None, "no outside value at a step", "no outside value at a step"] and path[-3]["y_pred"] is not None
    short = model.forecast_path(df, P, "y", folds.withColumn("train_start", F.expr("train_end - interval 3 hours")), 2).collect()
    assert [(r["y_pred"], r["reason"]) for r in short] == [(None, "too few training rows to fit")] * 2
