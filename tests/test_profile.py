"""Quantiles, ranks, dependence and stationarity against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopanel import Panel
from chronopanel.operators import dependence, profile, quantiles
from tests.helpers import column, holes, seasonal_values, series, union

P = Panel()


def values_of(df):
    return np.array(column(df, "y"))


@pytest.mark.parametrize("accuracy", [100_000, 100])
def test_exact_quantiles(spark, monkeypatch, accuracy):
    """Also with a coarse sketch, so that the brackets are really used."""
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.exponential(3, 3000), np.full(1500, 1.25), [1e9]])
    df = spark.createDataFrame([("a", float(x)) for x in v], "k string, y double").unionByName(
        spark.createDataFrame([("b", 4.0)], "k string, y double"))
    probs = [0.0, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = {(r.k, r.p): r.quantile for r in quantiles.exact_quantiles(df, ["k"], "y", probs).collect()}
    for p in probs:
        assert got[("a", p)] == pytest.approx(np.quantile(v, p)) and got[("b", p)] == 4.0
    whole = quantiles.exact_quantiles(df, [], "y", [0.5]).first().quantile
    assert whole == pytest.approx(np.quantile(np.append(v, 4.0), 0.5))


def test_ranks_with_ties_and_an_extreme_value(spark):
    v = [1.0] * 40 + [5.0, 2.0, 1e9, 0.5] + [2.0] * 9
    df = series(spark, v)
    got = profile.value_ranks(df, Panel(unit_rows=8), "y")
    order = sorted(range(len(v)), key=lambda i: (v[i], i))
    want = [0] * len(v)
    for place, i in enumerate(order, 1):
        want[i] = place
    assert column(got, "rank") == want and set(column(got, "n")) == {len(v)}


def test_histogram_keeps_the_maximum(spark):
    out = profile.histogram(series(spark, [0.0, 1.0, 2.0, 10.0]), P, "y", 5)
    assert {r.bin: r.n for r in out.collect()} == {1: 2, 2: 1, 5: 1}
    flat = profile.histogram(series(spark, [3.0, 3.0]), P, "y", 5).collect()
    assert [(r.bin, r.n) for r in flat] == [(1, 2)]


@pytest.mark.parametrize("unit", [30, 100000])
def test_acf_and_pacf(spark, unit):
    df = union(series(spark, seasonal_values(300)), series(spark, seasonal_values(200, 9), name="b"))
    y = values_of(df.filter("series_id = 'a'"))
    d = np.diff(y) - np.diff(y).mean()
    want = np.array([d[h:] @ d[: len(d) - h] for h in range(26)]) / (d @ d)
    p = Panel(unit_rows=unit)
    got = dependence.acf(df, p, "y", 25).filter("series_id = 'a'").orderBy("lag").collect()
    assert np.allclose([r.acf for r in got], want[1:]) and got[0].n == 299
    part = dependence.pacf(df, p, "y", 25).filter("series_id = 'a'").orderBy("lag").collect()
    for k in (1, 2, 24):
        toeplitz = want[np.abs(np.subtract.outer(np.arange(k), np.arange(k)))]
        assert part[k - 1].pacf == pytest.approx(np.linalg.solve(toeplitz, want[1 : k + 1])[-1])


def brute_adf(z, max_lag, lag=None):
    d = np.diff(z, prepend=np.nan)

    def fit(p, start):
        t = np.arange(start + 1, len(z))
        x = np.column_stack([np.ones(len(t)), z[t - 1], *(d[t - k] for k in range(1, p + 1))])
        b, *_ = np.linalg.lstsq(x, d[t], rcond=None)
        ssr, n, k = ((d[t] - x @ b) ** 2).sum(), len(t), x.shape[1]
        se = np.sqrt(ssr / (n - k) * np.linalg.inv(x.T @ x)[1, 1])
        return b[1] / se, n * np.log(ssr / n) + 2 * k, n

    best = lag if lag is not None else min(range(max_lag + 1), key=lambda p: fit(p, max_lag)[1])
    stat, _, n = fit(best, best)
    return stat, best, n


@pytest.mark.parametrize("unit, diff", [(64, 0), (100000, 1)])
def test_adf_against_least_squares(spark, unit, diff):
    rng = np.random.default_rng(4)
    y = np.cumsum(rng.normal(size=400))
    df = series(spark, [float(v) for v in y])
    z = np.diff(y) if diff else y
    row = dependence.adf(df, Panel(unit_rows=unit), "y", 12, diff=diff).first()
    stat, best, n = brute_adf(z, 12)
    assert row.used_lag == best and row.n_obs == n and row.adf_stat == pytest.approx(stat, rel=1e-6)
    fixed = dependence.adf(df, Panel(unit_rows=unit), "y", 12, diff=diff, select=None).first()
    assert fixed.adf_stat == pytest.approx(brute_adf(z, 12, 12)[0], rel=1e-6)


def test_adf_p_value_reference_points():
    # Asymptotic 1 %, 5 % and 10 % critical values of the constant case.
    for stat, p in ((-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.10)):
        assert dependence.adf_p_value(stat) == pytest.approx(p, abs=0.002)


def brute_kpss(y):
    n, r = len(y), y - y.mean()
    use = int(n ** (2 / 9))
    s0, s1 = (r @ r) / n, 0.0
    for i in range(1, use + 1):
        g = (r[i:] @ r[:-i]) / (n / 2)
        s0, s1 = s0 + g, s1 + i * g
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    var = (r @ r + 2 * sum((r[i:] @ r[:-i]) * (1 - i / (lags + 1)) for i in range(1, lags + 1))) / n
    return (np.cumsum(r) ** 2).sum() / n**2 / var, lags


@pytest.mark.parametrize("unit", [50, 100000])
def test_kpss_against_brute_force(spark, unit):
    rng = np.random.default_rng(8)
    walk, noise = np.cumsum(rng.normal(size=500)), rng.normal(size=300)
    df = union(series(spark, [float(v) for v in walk]), series(spark, [float(v) for v in noise], name="b"))
    got = {r.series_id: r for r in dependence.kpss(df, Panel(unit_rows=unit), "y").collect()}
    for name, y in (("a", walk), ("b", noise)):
        stat, lags = brute_kpss(y)
        assert got[name].kpss_lags == lags and got[name].kpss_stat == pytest.approx(stat, rel=1e-8)
        p = np.interp(stat, dependence.KPSS_CRITICAL, dependence.KPSS_P)
        assert got[name].kpss_p == pytest.approx(p, rel=1e-8)


def test_verdicts(spark):
    rng = np.random.default_rng(11)
    df = union(
        series(spark, [float(v) for v in np.cumsum(rng.normal(size=600))]),
        series(spark, [float(v) for v in rng.normal(size=600)], name="b"),
    )
    got = {r.series_id: r.verdict for r in dependence.stationarity(df, P, "y", 10).collect()}
    assert got == {"a": "non-stationary", "b": "stationary"}
    assert {r.verdict for r in dependence.stationarity(df.filter("series_id = 'a'"), P, "y", 10, diff=1).collect()} == {"stationary"}


def test_decomposition_recovers_the_cycle(spark):
    df = series(spark, [float(i) * 0.01 + (3.0 if i % 24 == 5 else 0.0) for i in range(240)])
    parts = profile.decompose(df, Panel(unit_rows=40), "y", 24)
    row = profile.decomposition_summary(parts, ["series_id"]).first()
    assert row.seasonal_amplitude == pytest.approx(3.0, abs=0.02) and row.remainder_std < 0.02
    assert parts.filter(F.col("trend").isNull()).count() == 24


def test_trailing_and_moving_average(spark):
    df = series(spark, [float(i) for i in range(10)])
    half = column(profile.trailing_stats(df, Panel(unit_rows=4), "y", 6), "roll_mean_6")
    assert half[:3] == [None, None, 1.0] and half[9] == pytest.approx(6.5)
    assert column(profile.moving_average(df, P, "y", 7), "ma_7")[5:7] == [None, 3.0]
    assert column(profile.difference(series(spark, holes([1.0, 2.0, 4.0], 0, 1)), P, "y"), "diff") == [None, 1.0, 2.0]


def test_anomalies_and_summaries(spark):
    df = series(spark, [1.0] * 50 + [100.0])
    assert sum(column(profile.anomalies(df, P, "y"), "is_anomaly")) == 1
    row = profile.scenario(df, ["series_id"], "y", 1.5).first()
    assert row.impact_pct == pytest.approx(50.0)
    with pytest.raises(ValueError):
        profile.scenario(df, ["series_id"], "y", 2.0)
    assert profile.extremes(df, P, "y").first().peak == 100.0


def test_ranks_are_counted_in_cells_of_bounded_size(spark, monkeypatch):
    """One series has nine tenths of the rows; no cell takes many more values than the panel's unit."""
    rng = np.random.default_rng(2)
    many, few = rng.normal(size=4500).round(6).tolist(), rng.normal(size=500).tolist()
    stored, real = [], profile.materialize
    monkeypatch.setattr(profile, "materialize", lambda df: stored.append(real(df)) or stored[-1])
    df = union(series(spark, many), series(spark, few, name="b"))
    got = profile.value_ranks(df, Panel(unit_rows=250), "y")
    assert column(got.filter("series_id = 'a'"), "rank") == (np.argsort(np.argsort(many, kind="stable"), kind="stable") + 1).tolist()
    assert column(got.filter("series_id = 'b'"), "rank") == (np.argsort(np.argsort(few)) + 1).tolist()
    cells = [r["count"] for r in stored[-1].groupBy("__cell").count().collect()]
    assert len(cells) >= 15 and max(cells) <= 3 * 250
