"""Features, the leakage guard, and plans."""

from datetime import date, timedelta
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chronopanel import Panel, PanelError
from chronopanel.functions import calendar, special
from chronopanel.operators import features, impute
from chronopanel.operators.registry import POWER_TARGET, POWER_UNSAFE, LeakageError, Registry, default_registry
from chronopanel.plans.units import row_index
from tests.helpers import column, holes, same, seasonal_values, series, union

P = Panel()


def plain_features(df, target, lags, windows):
    w = Window.partitionBy("series_id").orderBy("ts")
    fns = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    cols = [F.lag(target, n).over(w).alias(f"{target}_lag_{n}h") for n in lags]
    for n in windows:
        f = w.rowsBetween(-n, -1)
        cols += [F.when(F.count(target).over(f) == n, fn(target).over(f)).alias(f"{target}_roll_{s}_{n}h") for s, fn in fns.items()]
    return df.select("*", *cols)


@pytest.mark.parametrize("unit", [10, 200, 100000])
def test_blocks_equal_one_window_per_series(spark, unit):
    df = union(series(spark, holes(seasonal_values(900), 0.01, 5)), series(spark, seasonal_values(60, 7), name="b"))
    got = features.past_features(df, Panel(unit_rows=unit), "y", (1, 24, 168), (3, 24, 168))
    same(got, plain_features(df, "y", (1, 24, 168), (3, 24, 168)), tol=1e-9)


def test_row_positions_across_chunks(spark):
    df = union(series(spark, seasonal_values(100)), series(spark, seasonal_values(37), name="b", step=timedelta(hours=50)))
    got = row_index(df, Panel(unit_rows=7), "i")
    assert column(got, "i") == [*range(100), *range(37)]


def test_lag_after_short_gap_keeps_the_past_value(spark):
    filled = impute.fill_gaps(series(spark, [5.0, None, 50.0, 50.0, 50.0]), P, ["y"])
    assert column(features.past_features(filled, P, "y", (1,), ()), "y_lag_1h")[2] == 5.0


def test_rows_and_time_modes_differ_across_a_hole(spark):
    df = series(spark, [1.0, 2.0, 3.0, 4.0]).filter("y <> 2")
    assert column(features.past_features(df, P, "y", (1,), ()), "y_lag_1h") == [None, 1.0, 3.0]
    by_time = features.past_features(df, Panel(unit_rows=1), "y", (1,), (2,), mode="time")
    assert column(by_time, "y_lag_1h") == [None, None, 3.0]
    assert column(by_time, "y_roll_mean_2h") == [None, None, None]


def test_no_feature_sees_its_own_row_or_later(spark):
    values = seasonal_values(300)
    changed = values[:250] + [v + 1000 for v in values[250:]]
    build = lambda v: features.build_features(series(spark, v), Panel(unit_rows=64), "y").drop("y")
    limit = series(spark, values).orderBy("ts").collect()[250].ts
    same(build(values).filter(F.col("ts") <= F.lit(limit)), build(changed).filter(F.col("ts") <= F.lit(limit)))


def test_constant_series_has_zero_deviation(spark):
    out = features.past_features(series(spark, [0.1] * 400), P, "y", (), (24, 168))
    assert max(column(out.dropna(), "y_roll_std_168h")) < 1e-12


def test_default_matrix_has_31_features(spark):
    df = series(spark, seasonal_values(400), column=POWER_TARGET)
    for name in POWER_UNSAFE:
        df = df.withColumn(name, F.rand(1))
    df = df.withColumn("is_outage_gap", F.lit(0).cast("tinyint")).withColumn("is_originally_missing", F.lit(0).cast("tinyint"))
    df = df.withColumn("never_registered", F.lit(1.0))
    registry = default_registry(POWER_TARGET, POWER_UNSAFE)
    out = features.build_features(df, P, POWER_TARGET, registry=registry)
    names = features.feature_names(out, P, POWER_TARGET)
    assert len(names) == 31 and not set(names) & {*POWER_UNSAFE, "never_registered"}
    assert all(registry.is_safe(n) for n in names)
    assert out.count() == 400 - 168
    types = dict(out.dtypes)
    assert types["hour"] == "tinyint" and types["day_of_year"] == "smallint" and types["hour_sin"] == "float"


def test_guard(spark):
    df = series(spark, seasonal_values(10))
    bare = Registry().register("y", "raw", True)
    with pytest.raises(LeakageError, match="y_lag_1h"):
        features.build_features(df, P, "y", (1,), (), calendar=False, cyclical=False, holidays=False, registry=bare)
    loose = features.build_features(
        df, P, "y", (1,), (), calendar=False, cyclical=False, holidays=False, registry=bare, strict=False
    )
    assert loose.columns == ["series_id", "ts", "y", "y_lag_1h"]
    r = default_registry("y", unsafe=["v"])
    assert r.is_safe("v") is False and r.is_safe("nope") is None and r.is_safe("y_roll_std_24h") is True
    assert r.catalogue(spark).count() == len(r.specs)
    with pytest.raises(PanelError):
        features.build_features(df, P, "absent")
    with pytest.raises(PanelError):
        features.past_features(df, P, "y", (0,), ())
    with pytest.raises(PanelError):
        features.past_features(df, P, "y", (), (1,))


def test_feature_build_shares_one_upstream_and_one_block_exchange(spark, tmp_path):
    path = str(tmp_path / "panel")
    series(spark, seasonal_values(500)).write.parquet(path)
    df = features.build_features(spark.read.parquet(path), P, "y")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("hashpartitioning(series_id") <= 4
    assert plan.count(", __block#") >= 1
    blocks = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "__block" in line]
    assert len(blocks) == 1


def test_holidays_match_known_dates(spark):
    days = spark.sql("SELECT explode(sequence(DATE'2000-01-01', DATE'2030-12-31')) AS d").select(F.col("d").cast("timestamp_ntz").alias("ts"))
    flagged = days.select("ts", calendar.holiday_flag("ts")).filter("is_french_holiday = 1")
    got = {r.ts.date() for r in flagged.collect()}
    assert {date(2008, 3, 24), date(2008, 5, 1), date(2008, 5, 12), date(2024, 4, 1), date(2024, 5, 9), date(2024, 5, 20)} <= got
    assert date(2008, 12, 26) not in got
    table = calendar.holiday_dates(days.select(F.to_date("ts").alias("day")))
    assert {r.holiday_date for r in table.collect()} == got


def test_normal_quantile_expression(spark):
    ps = [0.001, 0.01, 0.0243, 0.3, 0.5, 0.77, 0.98, 0.9999]
    df = spark.createDataFrame([(p,) for p in ps], "p double").select("p", special.norm_quantile(F.col("p")).alias("z"))
    for r in df.collect():
        assert abs(r.z - NormalDist().inv_cdf(r.p)) < 1e-7


def test_sequence_samples(spark):
    values = [float(i) for i in range(30)]
    out = features.sequence_samples(series(spark, values), Panel(unit_rows=10), "y", 5).orderBy("ts").collect()
    m, s = np.mean(values), np.std(values) + 1e-8
    assert len(out) == 25
    assert np.allclose(out[0].history, (np.arange(5) - m) / s, atol=1e-5)
    assert abs(out[0].next_value * s + m - 5) < 1e-4
