import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopanel.operators.features import past_features, sliding_median
from chronopanel.panel import Panel
from tests.helpers import column, holes, same, seasonal_values, series, union


def plain(v, n):
    return [None if i < n or any(x is None or x != x for x in v[i - n : i]) else float(np.median(v[i - n : i])) for i in range(len(v))]


def test_medians_against_a_plain_version(spark):
    v = [round(x, 1) for x in seasonal_values(200)]
    v = holes(v, 0.02, 4)
    v[50] = float("nan")
    df = union(series(spark, v), series(spark, [2.0] * 9, name="b")).withColumn("tag", F.lit(None).cast("int"))
    one = past_features(df, Panel(unit_rows=8192), "y", (1,), (5, 24), stats=("median", "max"))
    assert one.columns[-4:] == ["y_roll_median_5h", "y_roll_max_5h", "y_roll_median_24h", "y_roll_max_24h"]
    for n in (5, 24):
        assert column(one.filter("series_id = 'a'"), f"y_roll_median_{n}h") == plain(v, n)
    assert column(one.filter("series_id = 'b'"), "y_roll_median_5h") == [None] * 5 + [2.0] * 4
    same(one.drop("tag", "y"), past_features(df, Panel(unit_rows=30), "y", (1,), (5, 24), stats=("median", "max")).drop("tag", "y"))


def test_a_long_window_costs_little_more():
    v = np.random.default_rng(0).normal(size=100_000)
    took = {}
    for n in (24, 168) * 3:
        start = time.perf_counter()
        sliding_median(v, n)
        took[n] = min(took.get(n, 9.0), time.perf_counter() - start)
    assert took[168] < 2 * took[24]
    assert np.array_equal(sliding_median(np.array([1.0, np.nan, 3.0, 5.0]), 1), [np.nan, 1.0, np.nan, 3.0], equal_nan=True)
    assert sliding_median(v[:500], 168)[400] == pytest.approx(np.median(v[232:400]))
