import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopanel.operators.loess import Stl, decompose_stl, loess
from chronopanel.panel import Panel, PanelError
from tests.helpers import column, same, seasonal_values, series, union

P = Panel(keys=("series_id",), freq="1h")


def line(y, x, q, w=None):
    """One local line, point by point."""
    n = len(y)
    lo = min(max(x - (q - 1) // 2, 0), max(n - q, 0))
    js = np.arange(lo, min(lo + q, n))
    h = max(x - js[0], js[-1] - x) + max(q - n, 0) // 2
    r = np.abs(js - x)
    k = np.where(r <= 0.001 * h, 1, np.where(r <= 0.999 * h, (1 - (r / h) ** 3) ** 3, 0)) * (1 if w is None else np.asarray(w)[js])
    if k.sum() <= 0:
        return y[min(max(x, 0), n - 1)]
    a, b = np.ones(len(js)), js - x
    m = np.array([[k.sum(), (k * b).sum()], [(k * b).sum(), (k * b * b).sum()]])
    return float(np.linalg.lstsq(m, np.array([(k * np.asarray(y)[js]).sum(), (k * b * np.asarray(y)[js]).sum()]), rcond=None)[0][0])


def stl(y, p, qs, qt, ql, inner, outer):
    n, y = len(y), np.asarray(y)
    trend, w = np.zeros(n), np.ones(n)
    mean = lambda v, k: np.array([np.mean(v[i : i + k]) for i in range(len(v) - k + 1)])
    for k in range(outer + 1):
        for _ in range(inner):
            cycle = np.zeros(n + 2 * p)
            for ph in range(p):
                sub, ws = (y - trend)[ph::p], w[ph::p]
                for j in range(-1, len(sub) + 1):
                    cycle[p + ph + j * p] = line(sub, j, qs, ws)
            low = mean(mean(mean(cycle, p), p), 3)
            season = cycle[p : p + n] - np.array([line(low, t, ql) for t in range(n)])
            trend = np.array([line(y - season, t, qt, w) for t in range(n)])
        if k < outer:
            r = np.abs(y - season - trend)
            h = 6 * np.median(r)
            w = np.where(r <= 0.001 * h, 1, np.where(r <= 0.999 * h, (1 - (r / h) ** 2) ** 2, 0))
    return trend, season


def test_loess_against_single_lines(spark):
    rng = np.random.default_rng(1)
    y = rng.normal(size=60).cumsum().tolist()
    df = union(series(spark, y), series(spark, y[:5], name="b"))
    for unit in (8192, 20):
        got = loess(df, Panel(unit_rows=unit), "y", 9)
        assert column(got.filter("series_id = 'a'"), "smooth") == pytest.approx([line(y, t, 9) for t in range(60)])
        assert column(got.filter("series_id = 'b'"), "smooth") == pytest.approx([line(y[:5], t, 9) for t in range(5)])
    with pytest.raises(PanelError):
        loess(df, P, "y", 8)


def test_stl_against_a_plain_version(spark):
    y = np.array(seasonal_values(6 * 12)) + np.linspace(0, 2, 72)
    y[[10, 33]] += 9
    how = Stl(period=6, seasonal=7, trend=11, low_pass=7, inner=2, outer=3)
    got = decompose_stl(series(spark, y.tolist()), P, "y", how)
    trend, season = stl(y, 6, 7, 11, 7, 2, 3)
    assert column(got, "trend") == pytest.approx(trend) and column(got, "seasonal") == pytest.approx(season)
    assert column(got, "remainder") == pytest.approx(y - trend - season)
    assert min(column(got, "robustness")) == 0 and got.orderBy("robustness").first()["y"] > 8


def test_blocks_change_nothing(spark):
    y = seasonal_values(6 * 120, noise=0.4)
    y[100], y[101], y[400] = None, None, float("nan")
    df = union(series(spark, y), series(spark, seasonal_values(7), name="short"))
    how = Stl(period=6, inner=1, outer=2)
    one, many = (decompose_stl(df, Panel(unit_rows=u), "y", how) for u in (8192, 150))
    same(one, many)
    assert one.filter("remainder is null").count() == 3 + 7 and one.filter("trend is null").count() == 7


def test_outliers_do_not_move_the_season(spark):
    clean = seasonal_values(24 * 30, noise=0.05)
    spoilt = [v + (20 if i in (100, 311, 500) else 0) for i, v in enumerate(clean)]
    a, b = (decompose_stl(series(spark, v), P, "y").select("ts", "seasonal") for v in (clean, spoilt))
    gap = a.join(b.withColumnRenamed("seasonal", "s"), "ts").agg(F.max(F.abs(F.col("seasonal") - F.col("s")))).first()[0]
    assert gap < 0.1 and Stl().windows == (47, 25)
    with pytest.raises(PanelError):
        Stl(seasonal=8)
