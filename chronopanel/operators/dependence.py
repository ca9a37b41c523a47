"""Serial dependence and stationarity: ACF, PACF, ADF, KPSS.

Cross products between a row and earlier rows are summed inside row blocks of
bounded size (numpy on one block at a time); the sums of all blocks are then
added up by Spark. Only a few hundred numbers per series reach the last step.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.functions.special import norm_cdf
from chronopanel.panel import Panel, PanelError
from chronopanel.plans.units import BLOCK, CHUNK, HALO, ROW, add_chunk, attach, chunk_window, row_blocks
from chronopanel.session import materialize

MAX_LAG = 168

# MacKinnon (1994) approximation of the ADF p-value, constant case, and
# MacKinnon (2010) surface of the 5 % critical value.
ADF_TAU_MIN, ADF_TAU_STAR, ADF_TAU_MAX = -18.83, -1.61, 2.74
ADF_SMALL_P = (2.1659, 1.4412, 0.038269)
ADF_LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)
ADF_CRITICAL_5 = (-2.86154, -2.8903, -4.234, -40.040)
# KPSS level-stationarity critical values and their p-values.
KPSS_CRITICAL = (0.347, 0.463, 0.574, 0.739)
KPSS_P = (0.10, 0.05, 0.025, 0.01)
KPSS_CRITICAL_5 = 0.463


def _centred_blocks(df: DataFrame, panel: Panel, value: str, back: int, diff: int) -> DataFrame:
    """Row blocks of ``__y`` with the series mean (of the differenced values) as ``__mean``.

    The mean of first differences is (last - first) / (n - 1).
    """
    src = df.filter(F.col(value).isNotNull()).select(*panel.keys, panel.ts, F.col(value).cast("double").alias("__y"))
    if diff:
        n = F.count(F.lit(1))
        mean = F.try_divide(F.max_by("__y", panel.ts) - F.min_by("__y", panel.ts), n - 1)
    else:
        mean = F.avg("__y")
    stats = src.groupBy(*panel.keys).agg(mean.alias("__mean"))
    return row_blocks(attach(src, panel, stats), panel, back=back + diff)


def _sum_blocks(
    blocks: DataFrame, panel: Panel, fn: Callable[[np.ndarray, np.ndarray, int, float], dict[tuple[int, int], float]]
) -> DataFrame:
    """Add up ``fn(values, rows, first_own, mean)`` over blocks: rows ``(keys, i, j, total)``."""
    keys = list(panel.keys)
    types = dict(blocks.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", i int, j int, total double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ROW)
        own = int(pdf[HALO].sum())
        sums = fn(pdf["__y"].to_numpy(), pdf[ROW].to_numpy(), own, float(pdf["__mean"].iloc[0]))
        out = pd.DataFrame({"i": [i for i, _ in sums], "j": [j for _, j in sums], "total": list(sums.values())})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "i", "j", "total"]]

    parts = blocks.groupBy(*keys, BLOCK).applyInPandas(run, schema)
    return parts.groupBy(*keys, "i", "j").agg(F.sum("total").alias("total"))


def lag_products(df: DataFrame, panel: Panel, value: str, max_lag: int = MAX_LAG, diff: int = 0) -> DataFrame:
    """Sums of centred products ``x[t] * x[t-h]`` for h = 0..max_lag: ``(keys, lag, total, n)``.

    ``diff=1`` takes first differences before.
    """
    if diff not in (0, 1):
        raise PanelError("diff must be 0 or 1")

    def products(y: np.ndarray, rows: np.ndarray, own: int, mean: float) -> dict[tuple[int, int], float]:
        if diff:
            y = np.diff(y)
            own = max(own - 1, 0)
        x = y - mean
        out = {}
        for h in range(max_lag + 1):
            start = max(own, h)
            out[(h, 0)] = float(x[start:] @ x[start - h : len(x) - h]) if start < len(x) else 0.0
        out[(-1, 0)] = float(len(x) - own)
        return out

    sums = _sum_blocks(_centred_blocks(df, panel, value, max_lag, diff), panel, products)
    # max_lag + 2 rows per series.
    n = F.max(F.when(F.col("i") == -1, F.col("total"))).over(Window.partitionBy(*panel.keys))
    return sums.withColumn("n", n.cast("bigint")).filter(F.col("i") >= 0).select(
        *panel.keys, F.col("i").alias("lag"), "total", "n"
    )


def acf(df: DataFrame, panel: Panel, value: str, max_lag: int = MAX_LAG, diff: int = 1) -> DataFrame:
    """Autocorrelation at lags 1..max_lag (sums divided by n at every lag)."""
    p = lag_products(df, panel, value, max_lag, diff)
    zero = F.max(F.when(F.col("lag") == 0, F.col("total"))).over(Window.partitionBy(*panel.keys))
    return p.withColumn("acf", F.try_divide("total", zero)).filter(F.col("lag") > 0).select(*panel.keys, "lag", "acf", "n")


def _partial(rho: np.ndarray) -> np.ndarray:
    """Durbin-Levinson recursion: partial autocorrelations from autocorrelations at 1..m."""
    out, phi, var = np.empty(len(rho)), np.zeros(0), 1.0
    for k, r in enumerate(rho):
        last = (r - phi @ rho[:k][::-1]) / var
        phi = np.append(phi - last * phi[::-1], last)
        var *= 1 - last * last
        out[k] = last
    return out


def pacf(df: DataFrame, panel: Panel, value: str, max_lag: int = MAX_LAG, diff: int = 1) -> DataFrame:
    """Partial autocorrelation at lags 1..max_lag by Yule-Walker; max_lag rows per series."""
    table = acf(df, panel, value, max_lag, diff).drop("n")
    keys = list(panel.keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lag")
        return pdf.assign(pacf=_partial(pdf["acf"].to_numpy(dtype="float64")))[[*keys, "lag", "pacf"]]

    types = dict(table.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", lag int, pacf double"
    return table.groupBy(*keys).applyInPandas(run, schema)


# --- unit-root test -----------------------------------------------------------------

def adf_p_value(stat: float) -> float:
    if stat > ADF_TAU_MAX:
        return 1.0
    if stat < ADF_TAU_MIN:
        return 0.0
    coefs = ADF_SMALL_P if stat <= ADF_TAU_STAR else ADF_LARGE_P
    return norm_cdf(sum(c * stat**k for k, c in enumerate(coefs)))


def adf_critical_5(n: int) -> float:
    return sum(c / n**k for k, c in enumerate(ADF_CRITICAL_5))


def _design(z: np.ndarray, max_lag: int, rows: np.ndarray) -> np.ndarray:
    """Columns: 1, previous level, previous differences 1..max_lag, current difference."""
    d = np.diff(z, prepend=np.nan)
    cols = [np.ones(len(rows)), z[rows - 1], *(d[rows - k] for k in range(1, max_lag + 1)), d[rows]]
    return np.column_stack(cols)


def _fit(gram: np.ndarray, n: int, lags: int) -> tuple[float, float, float]:
    """(t statistic of the level, residual sum of squares, AIC) with the given number of lags."""
    use, y = np.arange(lags + 2), gram.shape[0] - 1
    inv = np.linalg.pinv(gram[np.ix_(use, use)])
    beta = inv @ gram[use, y]
    ssr = max(float(gram[y, y] - beta @ gram[use, y]), 1e-300)
    k = len(use)
    llf = -n / 2 * (math.log(2 * math.pi) + math.log(ssr / n) + 1)
    se = math.sqrt(ssr / (n - k) * inv[1, 1])
    return float(beta[1] / se), ssr, -2 * llf + 2 * k


def adf(
    df: DataFrame, panel: Panel, value: str, max_lag: int = 40, diff: int = 0, select: str | None = "AIC"
) -> DataFrame:
    """Augmented Dickey-Fuller test with a constant: ``(keys, adf_stat, adf_p, adf_crit_5, used_lag, n_obs)``.

    With ``select="AIC"`` the number of lags is chosen on the rows all choices
    share and the winner refitted on every row it can use; None takes max_lag.
    """
    size = max_lag + 3

    def gram(y: np.ndarray, rows: np.ndarray, own: int, mean: float) -> dict[tuple[int, int], float]:
        # Positions count in the (possibly differenced) series; the mean only improves conditioning.
        if diff:
            y, rows, own = np.diff(y), rows[1:] - 1, max(own - 1, 0)
        z = y - mean
        out: dict[tuple[int, int], float] = {}
        at = np.arange(max(own, max_lag + 1), len(z))
        if len(at):
            v = _design(z, max_lag, at)
            g = v.T @ v
            out.update({(i, j): float(g[i, j]) for i in range(size) for j in range(i, size)})
            out[(-2, 0)] = float(len(at))
        for pos, row in enumerate(rows[own:], start=own):
            if row > max_lag:
                break
            out[(-1, int(row))] = float(z[pos])
        return out

    sums = _sum_blocks(_centred_blocks(df, panel, value, max_lag + 1, diff), panel, gram)
    keys = list(panel.keys)
    types = dict(sums.dtypes)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        g, head, n = np.zeros((size, size)), np.zeros(max_lag + 1), 0
        for i, j, total in zip(pdf["i"], pdf["j"], pdf["total"]):
            if i >= 0:
                g[i, j] = g[j, i] = total
            elif i == -1:
                head[j] = total
            else:
                n = int(total)
        row = {k: pdf[k].iloc[0] for k in keys}
        if n <= size:
            return pd.DataFrame([{**row, "adf_stat": None, "adf_p": None, "adf_crit_5": None, "used_lag": None, "n_obs": n}])
        best = max_lag
        if select == "AIC":
            best = min(range(max_lag + 1), key=lambda p: _fit(g, n, p)[2])
        keep = [*range(best + 2), size - 1]
        g2 = g[np.ix_(keep, keep)]
        extra = np.arange(best + 1, max_lag + 1)
        if len(extra):
            v = _design(head, best, extra)
            g2 = g2 + v.T @ v
        n2 = n + len(extra)
        stat = _fit(g2, n2, best)[0]
        return pd.DataFrame([{**row, "adf_stat": stat, "adf_p": adf_p_value(stat), "adf_crit_5": adf_critical_5(n2),
                              "used_lag": best, "n_obs": n2}])

    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + (
        ", adf_stat double, adf_p double, adf_crit_5 double, used_lag int, n_obs bigint"
    )
    # One series' sums: (max_lag + 3) squared numbers.
    return sums.groupBy(*keys).applyInPandas(solve, schema)


# --- level stationarity ---------------------------------------------------------------

def _auto_lags(pdf: pd.DataFrame) -> int:
    """Bandwidth of Hobijn, Franses and Ooms (1998) for the Bartlett kernel."""
    n = int(pdf["n"].iloc[0])
    cov = pdf.sort_values("lag")["total"].to_numpy()
    use = min(int(n ** (2 / 9)), len(cov) - 1)
    s0 = cov[0] / n + sum(cov[i] / (n / 2) for i in range(1, use + 1))
    s1 = sum(i * cov[i] / (n / 2) for i in range(1, use + 1))
    ratio = s1 / s0 if s0 else 0.0
    return max(0, min(int(1.1447 * (ratio * ratio) ** (1 / 3) * n ** (1 / 3)), n - 1))


def partial_sum_squares(df: DataFrame, panel: Panel, value: str) -> DataFrame:
    """Sum over t of the squared running sum of centred values, from per-chunk sums."""
    src = df.filter(F.col(value).isNotNull()).select(*panel.keys, panel.ts, F.col(value).cast("double").alias("__y"))
    stats = src.groupBy(*panel.keys).agg(F.avg("__y").alias("__mean"))
    x = attach(src, panel, stats).withColumn("__x", F.col("__y") - F.col("__mean"))
    running = F.sum("__x").over(chunk_window(panel).rowsBetween(Window.unboundedPreceding, 0))
    chunks = (
        add_chunk(x, panel).withColumn("__c", running).groupBy(*panel.keys, CHUNK)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("__x").alias("s"), F.sum("__c").alias("q1"), F.sum(F.col("__c") ** 2).alias("q2"))
    )
    before = Window.partitionBy(*panel.keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    off = F.coalesce(F.sum("s").over(before), F.lit(0.0))
    return (
        chunks.withColumn("o", off).groupBy(*panel.keys)
        .agg(F.sum(F.col("n") * F.col("o") * F.col("o") + 2 * F.col("o") * F.col("q1") + F.col("q2")).alias("sum_squares"))
    )


def kpss(df: DataFrame, panel: Panel, value: str, diff: int = 0, lags: int | None = None) -> DataFrame:
    """KPSS test around a level: ``(keys, kpss_stat, kpss_p, kpss_crit_5, kpss_lags)``.

    The p-value is interpolated in the published table and clipped to [0.01, 0.1].
    ``lags=None`` picks the bandwidth from the data, which takes a look at the
    short autocovariances first.
    """
    keys = list(panel.keys)
    if diff:
        from chronopanel.operators.profile import difference

        df = materialize(difference(df, panel, value, "__d").filter(F.col("__d").isNotNull()).select(
            *keys, panel.ts, F.col("__d").alias(value)))
    longest = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    types = dict(df.dtypes)
    key_schema = ", ".join(f"`{k}` {types[k]}" for k in keys)
    first = int(longest ** (2 / 9)) + 1 if lags is None else lags
    cov = lag_products(df, panel, value, first)
    if lags is None:
        def bandwidth(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "kpss_lags": _auto_lags(pdf)}])

        wanted = materialize(cov.groupBy(*keys).applyInPandas(bandwidth, f"{key_schema}, kpss_lags int"))
        need = wanted.agg(F.max("kpss_lags")).first()[0] or 0
        cov = lag_products(df, panel, value, max(need, 0)).join(wanted, keys)
    else:
        cov = cov.withColumn("kpss_lags", F.lit(lags))
    weight = F.when(F.col("lag") == 0, 1.0).when(
        F.col("lag") <= F.col("kpss_lags"), 2.0 * (1 - F.col("lag") / (F.col("kpss_lags") + 1))
    ).otherwise(0.0)
    variance = cov.groupBy(*keys, "n", "kpss_lags").agg((F.sum(F.col("total") * weight) / F.first("n")).alias("__var"))
    out = variance.join(partial_sum_squares(df, panel, value), keys)
    stat = F.try_divide(F.col("sum_squares") / (F.col("n") * F.col("n")), "__var")
    return out.select(*keys, stat.alias("kpss_stat"), "kpss_lags").select(
        *keys, "kpss_stat", kpss_p(F.col("kpss_stat")).alias("kpss_p"), F.lit(KPSS_CRITICAL_5).alias("kpss_crit_5"), "kpss_lags"
    )


def kpss_p(stat):
    """Linear interpolation between the table's critical values."""
    out = F.when(stat <= KPSS_CRITICAL[0], F.lit(KPSS_P[0]))
    for c0, c1, p0, p1 in zip(KPSS_CRITICAL, KPSS_CRITICAL[1:], KPSS_P, KPSS_P[1:]):
        out = out.when(stat <= c1, F.lit(p0) + (stat - c0) * ((p1 - p0) / (c1 - c0)))
    return out.when(stat.isNotNull(), F.lit(KPSS_P[-1]))


def stationarity(df: DataFrame, panel: Panel, value: str, max_lag: int = 40, diff: int = 0, alpha: float = 0.05, select: str | None = "AIC") -> DataFrame:
    """Both tests and the joint verdict; null with a ``reason`` where a test has no statistic.

    "mixed" means that both tests spoke and disagree. A series without values is in the result as well.
    """
    keys = list(panel.keys)
    tests = adf(df, panel, value, max_lag, diff, select).join(kpss(df, panel, value, diff), keys, "full")
    both = df.select(*keys).distinct().join(tests, keys, "left")
    by_adf, by_kpss = F.col("adf_p") < alpha, F.col("kpss_p") > alpha
    flat = F.col("kpss_stat").isNull() | F.isnan("kpss_stat")
    short = F.col("adf_stat").isNull() | F.isnan("adf_stat")
    reason = F.when(flat, "constant or without values").when(short, f"too few rows for {max_lag} lags")
    verdict = F.when(by_adf & by_kpss, "stationary").when(~by_adf & ~by_kpss, "non-stationary").otherwise("mixed")
    return both.withColumn("verdict", F.when(~flat & ~short, verdict)).withColumn("reason", reason)
