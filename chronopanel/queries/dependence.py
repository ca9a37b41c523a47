"""Autocorrelation, stationarity and seasonal ARIMA."""

from pyspark.sql import functions as F

from chronopanel.operators import arima, dependence, evaluate, forecast
from chronopanel.operators.css import CssArima
from chronopanel.plans.folds import fold_plan
from chronopanel.plans.units import small_join
from chronopanel.queries.base import HOURLY_FOLDS, HOURLY_PANEL, HOURLY_SQL, R, folds_sql, hourly, query, table
from chronopanel.session import materialize

DIFF_SQL = HOURLY_SQL + """,
d AS (SELECT series_id, ts, value - lag(value) OVER (PARTITION BY series_id ORDER BY ts) AS d FROM hourly),
x AS (SELECT series_id, d - avg(d) OVER (PARTITION BY series_id) AS x, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS i
      FROM d WHERE d IS NOT NULL),
c0 AS (SELECT series_id, sum(x * x) AS v, count(*) AS n FROM x GROUP BY 1)"""


@query("w8_acf", f"""WITH {DIFF_SQL}, lags AS (SELECT CAST(unnest(generate_series(1, 168)) AS BIGINT) AS lag),
p AS (SELECT a.series_id, l.lag, sum(a.x * b.x) AS s FROM x a, lags l, x b
      WHERE a.series_id = b.series_id AND b.i = a.i - l.lag GROUP BY 1, 2)
SELECT series_id, lag, {R('s / v')} AS acf, n FROM p JOIN c0 USING (series_id)""")
def acf(spark, sf):
    return dependence.acf(hourly(spark, sf), HOURLY_PANEL, "value", 168)


@query("w9_pacf")
def pacf(spark, sf):
    return dependence.pacf(hourly(spark, sf), HOURLY_PANEL, "value", 168)


# The recursion in closed form: lags 1 to 3 from the first three autocorrelations.
@query("w9_pacf_first_lags", f"""WITH {DIFF_SQL},
r AS (SELECT x.series_id, sum(x * p1) / any_value(v) AS r1, sum(x * p2) / any_value(v) AS r2, sum(x * p3) / any_value(v) AS r3
      FROM (SELECT series_id, x, lag(x, 1) OVER w AS p1, lag(x, 2) OVER w AS p2, lag(x, 3) OVER w AS p3 FROM x WINDOW w AS (PARTITION BY series_id ORDER BY i)) x
      JOIN c0 USING (series_id) GROUP BY 1)
SELECT series_id, 1::BIGINT AS lag, {R('r1')} AS pacf FROM r
UNION ALL SELECT series_id, 2, {R('(r2 - r1 * r1) / (1 - r1 * r1)')} FROM r
UNION ALL SELECT series_id, 3, {R('(r3 - 2 * r1 * r2 + r1 ** 3 + r1 * r2 ** 2 - r1 ** 2 * r3) / (1 - 2 * r1 ** 2 - r2 ** 2 + 2 * r1 ** 2 * r2)')} FROM r""")
def pacf_first(spark, sf):
    return dependence.pacf(materialize(hourly(spark, sf)), HOURLY_PANEL, "value", 3)


# Normal equations of d = a + b * level before + c * difference before, centred, so two by two.
@query("w13_adf_one_lag", f"""WITH {HOURLY_SQL},
d AS (SELECT series_id, value - lag(value) OVER w AS y, lag(value) OVER w AS l, lag(value) OVER w - lag(value, 2) OVER w AS p
      FROM hourly WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
s AS (SELECT series_id, count(*) AS n, var_pop(l) * count(*) AS ll, var_pop(p) * count(*) AS pp, covar_pop(l, p) * count(*) AS lp,
             covar_pop(l, y) * count(*) AS ly, covar_pop(p, y) * count(*) AS py, var_pop(y) * count(*) AS yy FROM d WHERE p IS NOT NULL GROUP BY 1),
b AS (SELECT *, ll * pp - lp * lp AS det, (pp * ly - lp * py) / (ll * pp - lp * lp) AS b, (ll * py - lp * ly) / (ll * pp - lp * lp) AS c FROM s)
SELECT series_id, {R('b / sqrt((yy - b * ly - c * py) / (n - 3) * pp / det)', 5)} AS adf_stat, n AS n_obs FROM b""")
def adf_one_lag(spark, sf):
    out = dependence.adf(materialize(hourly(spark, sf)), HOURLY_PANEL, "value", 1, select=None)
    return out.select("series_id", F.round(F.col("adf_stat") + 2.3e-9, 5).alias("adf_stat"), "n_obs")


@query("w13_adf")
def adf(spark, sf):
    return dependence.adf(materialize(hourly(spark, sf)), HOURLY_PANEL, "value", 40)


@query("w13_adf_fixed_lag")
def adf_fixed(spark, sf):
    return dependence.adf(materialize(hourly(spark, sf)), HOURLY_PANEL, "value", 40, select=None)


@query("w14_kpss", f"""WITH {HOURLY_SQL}, x AS (SELECT series_id, ts, value - avg(value) OVER (PARTITION BY series_id) AS x,
  row_number() OVER (PARTITION BY series_id ORDER BY ts) AS i, count(*) OVER (PARTITION BY series_id) AS n FROM hourly),
s AS (SELECT series_id, n, sum(x) OVER (PARTITION BY series_id ORDER BY i) AS s FROM x),
e AS (SELECT series_id, n, sum(s * s) / (n * n) AS eta FROM s GROUP BY 1, 2),
p AS (SELECT a.series_id, a.i - b.i AS lag, sum(a.x * b.x) AS g FROM x a JOIN x b ON a.series_id = b.series_id AND a.i - b.i BETWEEN 0 AND 8 GROUP BY 1, 2),
v AS (SELECT series_id, sum(g * CASE WHEN lag = 0 THEN 1 ELSE 2 * (1 - lag / 9) END) AS v FROM p GROUP BY 1)
SELECT series_id, {R('eta / (v / n)')} AS kpss_stat FROM e JOIN v USING (series_id)""")
def kpss(spark, sf):
    return dependence.kpss(materialize(hourly(spark, sf)), HOURLY_PANEL, "value", lags=8).select("series_id", "kpss_stat")


# The bandwidth from the first covariances (up to n ** (2/9)), then the Bartlett sum up to it.
KPSS_SQL = HOURLY_SQL + """,
x AS (SELECT series_id, ts, value - avg(value) OVER (PARTITION BY series_id) AS x,
  row_number() OVER (PARTITION BY series_id ORDER BY ts) AS i, count(*) OVER (PARTITION BY series_id) AS n FROM hourly),
s AS (SELECT series_id, n, sum(x) OVER (PARTITION BY series_id ORDER BY i) AS s FROM x),
e AS (SELECT series_id, n, sum(s * s) / (n * n) AS eta FROM s GROUP BY 1, 2),
p AS (SELECT a.series_id, a.i - b.i AS lag, any_value(a.n) AS n, sum(a.x * b.x) AS g FROM x a JOIN x b ON a.series_id = b.series_id AND a.i - b.i BETWEEN 0 AND a.n - 1 GROUP BY 1, 2),
q AS (SELECT series_id, any_value(n) AS n, sum(CASE WHEN lag = 0 THEN g / n ELSE 2 * g / n END) AS s0, sum(lag * 2 * g / n) AS s1
      FROM p WHERE lag <= floor(power(n, 2.0 / 9)) GROUP BY 1),
l AS (SELECT series_id, greatest(0, least(floor(1.1447 * power(power(s1 / s0, 2), 1.0 / 3) * power(n, 1.0 / 3)), n - 1))::BIGINT AS kpss_lags FROM q),
v AS (SELECT series_id, kpss_lags, sum(g * CASE WHEN lag = 0 THEN 1 ELSE 2 * (1 - lag / (kpss_lags + 1)) END) AS v FROM p JOIN l USING (series_id) WHERE lag <= kpss_lags GROUP BY 1, 2),
k AS (SELECT series_id, kpss_lags, eta / (v / n) AS kpss_stat FROM e JOIN v USING (series_id)),
kpss AS (SELECT *, CASE WHEN kpss_stat <= 0.347 THEN 0.1 WHEN kpss_stat <= 0.463 THEN 0.1 - (kpss_stat - 0.347) * 0.05 / 0.116
  WHEN kpss_stat <= 0.574 THEN 0.05 - (kpss_stat - 0.463) * 0.025 / 0.111 WHEN kpss_stat <= 0.739 THEN 0.025 - (kpss_stat - 0.574) * 0.015 / 0.165 ELSE 0.01 END AS kpss_p FROM k)"""


@query("w14_kpss_automatic", f"WITH {KPSS_SQL} SELECT series_id, kpss_lags, {R('kpss_stat')} AS kpss_stat, {R('kpss_p')} AS kpss_p FROM kpss")
def kpss_automatic(spark, sf):
    return dependence.kpss(materialize(hourly(spark, sf)), HOURLY_PANEL, "value").select("series_id", "kpss_lags", "kpss_stat", "kpss_p")


# With one lag the unit-root statistic has a closed form; its p-value is under 5 % where the polynomial is under the normal 5 % point.
@query("w14_verdict_one_lag", f"""WITH {KPSS_SQL},
d AS (SELECT series_id, value - lag(value) OVER w AS y, lag(value) OVER w AS l, lag(value) OVER w - lag(value, 2) OVER w AS p
      FROM hourly WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
c AS (SELECT series_id, count(*) AS n, var_pop(l) * count(*) AS ll, var_pop(p) * count(*) AS pp, covar_pop(l, p) * count(*) AS lp,
             covar_pop(l, y) * count(*) AS ly, covar_pop(p, y) * count(*) AS py, var_pop(y) * count(*) AS yy FROM d WHERE p IS NOT NULL GROUP BY 1),
b AS (SELECT *, ll * pp - lp * lp AS det, (pp * ly - lp * py) / (ll * pp - lp * lp) AS b, (ll * py - lp * ly) / (ll * pp - lp * lp) AS c FROM c),
t AS (SELECT series_id, b / sqrt((yy - b * ly - c * py) / (n - 3) * pp / det) AS t FROM b),
a AS (SELECT series_id, t, CASE WHEN t > 2.74 THEN false WHEN t < -18.83 THEN true WHEN t <= -1.61 THEN 2.1659 + 1.4412 * t + 0.038269 * t * t < -1.6448536269514722
  ELSE 1.7339 + 0.93202 * t - 0.12745 * t * t - 0.010368 * t * t * t < -1.6448536269514722 END AS rejects FROM t)
SELECT series_id, kpss_lags, {R('t', 5)} AS adf_stat, CASE WHEN rejects AND kpss_p > 0.05 THEN 'stationary' WHEN NOT rejects AND kpss_p <= 0.05 THEN 'non-stationary' ELSE 'mixed' END AS verdict
FROM kpss JOIN a USING (series_id)""")
def verdict_one_lag(spark, sf):
    out = dependence.stationarity(materialize(hourly(spark, sf)), HOURLY_PANEL, "value", 1, select=None)
    return out.select("series_id", "kpss_lags", F.round(F.col("adf_stat") + 2.3e-9, 5).alias("adf_stat"), "verdict")


@query("w14_stationarity_verdict")
def stationarity(spark, sf):
    return dependence.stationarity(materialize(hourly(spark, sf)), HOURLY_PANEL, "value", 40)


def arima_inputs(spark, sf):
    h = materialize(hourly(spark, sf))
    return h, fold_plan(h, HOURLY_PANEL, **{**HOURLY_FOLDS, "n_folds": 3, "train_days": 14}, strict=False).persist()


@query("m7_seasonal_arima")
def seasonal_arima(spark, sf):
    """(1, 1, 1) x (1, 1, 1, 24) by conditional sums of squares."""
    h, folds = arima_inputs(spark, sf)
    return CssArima().predictions(h, HOURLY_PANEL, "value", folds)


@query("m7_seasonal_arima_scores")
def seasonal_arima_scores(spark, sf):
    h, folds = arima_inputs(spark, sf)
    run = forecast.backtest(h, HOURLY_PANEL, "value", folds, [CssArima()], features=[])
    return evaluate.score(run.predictions, ["series_id", "fold", "model"]).drop(*evaluate.CHECKS)


@query("m7_two_stage_arima")
def two_stage_arima(spark, sf):
    """The same orders by two-stage least squares, additive and in two aggregations."""
    h, folds = arima_inputs(spark, sf)
    return arima.SeasonalArima(name="two_stage").predictions(h, HOURLY_PANEL, "value", folds)


@query("m7_innovations", f"""WITH {HOURLY_SQL}, {folds_sql('hourly', 3, 14, 3)},
w AS (SELECT series_id, ts, value, value - lag(value) OVER (PARTITION BY series_id ORDER BY ts) AS w FROM hourly),
r AS (SELECT f.series_id, f.fold, w.ts, w.value, row_number() OVER (PARTITION BY f.series_id, f.fold ORDER BY w.ts) - 1 AS "at", w.w
      FROM w JOIN folds f ON w.series_id = f.series_id AND w.ts BETWEEN f.train_start AND f.valid_end),
p AS (SELECT series_id, fold, max(CASE WHEN "at" = 1 THEN w END) AS w1, max(CASE WHEN "at" = 2 THEN w END) AS w2, max(CASE WHEN "at" = 3 THEN w END) AS w3 FROM r GROUP BY 1, 2),
e AS (SELECT *, w1 AS e1, w2 - 0.4 * w1 AS e2, w3 - 0.4 * (w2 - 0.4 * w1) AS e3 FROM p)
SELECT series_id, fold, r.ts, "at", {R('CASE "at" WHEN 1 THEN e1 WHEN 2 THEN e2 WHEN 3 THEN e3 ELSE 0 END')} AS e, "at" > 0 AS whole
FROM r JOIN e USING (series_id, fold) WHERE "at" <= 3""")
def innovations(spark, sf):
    """The recurrence of a moving average of order one under a given weight, over the first steps of every window."""
    h, folds = arima_inputs(spark, sf)
    model = CssArima((0, 1, 1), (0, 0, 0, 24))
    return model.innovations(h, HOURLY_PANEL, "value", folds, {"ma_1": 0.4}).filter("at <= 3")


@query("m10_recursive_forecast")
def recursive_forecast(spark, sf):
    h, folds = arima_inputs(spark, sf)
    return CssArima().forecast_path(h, HOURLY_PANEL, "value", folds, horizon=72)


# An autoregression of order one on differences: its two least-squares stages come down to one line per series and fold.
AR_SQL = HOURLY_SQL + """,
d AS (SELECT series_id, ts, value, lag(value) OVER w AS y1, value - lag(value) OVER w AS d, lag(value) OVER w - lag(value, 2) OVER w AS d1,
             row_number() OVER w AS rn FROM hourly WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
""" + folds_sql("hourly", 3, 14, 3) + """,
fit AS (SELECT d.series_id, f.fold, regr_slope(d, d1) AS b, regr_intercept(d, d1) AS a FROM d JOIN folds f
        ON d.series_id = f.series_id AND d.ts BETWEEN f.train_start AND f.train_end WHERE rn > 50 GROUP BY 1, 2)"""
AR_MODEL = arima.SeasonalArima((1, 1, 0), (0, 0, 0, 24), name="ar_1")


@query("m7_autoregression", f"""WITH {AR_SQL}
SELECT d.series_id, 'ar_1' AS model, f.fold, d.ts, {R('d.value')} AS y_true, {R('y1 + a + b * d1', 3)} AS y_pred
FROM d JOIN folds f ON d.series_id = f.series_id AND d.ts BETWEEN f.valid_start AND f.valid_end JOIN fit ON fit.series_id = f.series_id AND fit.fold = f.fold
WHERE rn > 50""")
def autoregression(spark, sf):
    h, folds = arima_inputs(spark, sf)
    out = AR_MODEL.predictions(h, HOURLY_PANEL, "value", folds)
    return out.withColumn("y_pred", F.round(F.col("y_pred") + 2.3e-9, 3))


@query("m10_autoregressive_path", f"""WITH {AR_SQL},
o AS (SELECT f.series_id, f.fold, f.train_end, e.value, e.d, e.rn FROM folds f LEFT JOIN d e ON e.series_id = f.series_id AND e.ts = f.train_end),
s AS (SELECT o.*, a, b FROM o JOIN fit USING (series_id, fold)),
w AS (SELECT series_id, fold, train_end, CASE WHEN rn > 50 THEN value END AS y0, a + b * d AS d1, a + b * (a + b * d) AS d2, a + b * (a + b * (a + b * d)) AS d3 FROM s)
SELECT series_id, 'ar_1' AS model, fold, 1::BIGINT AS h, train_end + INTERVAL 1 HOUR AS ts, {R('y0 + d1', 3)} AS y_pred,
  CASE WHEN y0 IS NULL THEN 'no row at the end of the training window' END AS reason FROM w
UNION ALL SELECT series_id, 'ar_1', fold, 2, train_end + INTERVAL 2 HOUR, {R('y0 + d1 + d2', 3)}, CASE WHEN y0 IS NULL THEN 'no row at the end of the training window' END FROM w
UNION ALL SELECT series_id, 'ar_1', fold, 3, train_end + INTERVAL 3 HOUR, {R('y0 + d1 + d2 + d3', 3)}, CASE WHEN y0 IS NULL THEN 'no row at the end of the training window' END FROM w""")
def autoregressive_path(spark, sf):
    h, folds = arima_inputs(spark, sf)
    out = AR_MODEL.forecast_path(h, HOURLY_PANEL, "value", folds, 3)
    return out.withColumn("y_pred", F.round(F.col("y_pred") + 2.3e-9, 3))


# The same with an outside column: all events of the hour. Two regressors, so the weights come from two by two covariances.
EXOG_MODEL = arima.SeasonalArima((1, 1, 0), (0, 0, 0, 24), exog=("external_events",), name="ar_1_exog")
EXOG_SQL = HOURLY_SQL + """,
counts AS (SELECT date_trunc('hour', ts) AS ts, count(*)::DOUBLE AS x FROM events GROUP BY 1),
joined AS (SELECT series_id, ts, value, x FROM hourly JOIN counts USING (ts)),
d AS (SELECT series_id, ts, value, value - lag(value) OVER w AS d, lag(value) OVER w - lag(value, 2) OVER w AS d1, x - lag(x) OVER w AS dx,
             row_number() OVER w AS rn FROM joined WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
""" + folds_sql("hourly", 3, 14, 3) + """,
c AS (SELECT d.series_id, f.fold, var_pop(d1) AS s11, var_pop(dx) AS s22, covar_pop(d1, dx) AS s12, covar_pop(d, d1) AS s1, covar_pop(d, dx) AS s2,
             avg(d) AS m, avg(d1) AS m1, avg(dx) AS m2
      FROM d JOIN folds f ON d.series_id = f.series_id AND d.ts BETWEEN f.train_start AND f.train_end WHERE rn > 50 GROUP BY 1, 2),
fit AS (SELECT series_id, fold, b, g, m - b * m1 - g * m2 AS a
        FROM (SELECT *, (s22 * s1 - s12 * s2) / (s11 * s22 - s12 * s12) AS b, (s11 * s2 - s12 * s1) / (s11 * s22 - s12 * s12) AS g FROM c)),
o AS (SELECT f.series_id, f.fold, f.train_end, CASE WHEN e.rn > 50 THEN e.value END AS y0, e.d AS d0 FROM folds f LEFT JOIN d e ON e.series_id = f.series_id AND e.ts = f.train_end),
x AS (SELECT o.*, a, b, g, x1.dx AS x1, x2.dx AS x2, x3.dx AS x3 FROM o JOIN fit USING (series_id, fold)
      LEFT JOIN d x1 ON x1.series_id = o.series_id AND x1.ts = o.train_end + INTERVAL 1 HOUR
      LEFT JOIN d x2 ON x2.series_id = o.series_id AND x2.ts = o.train_end + INTERVAL 2 HOUR
      LEFT JOIN d x3 ON x3.series_id = o.series_id AND x3.ts = o.train_end + INTERVAL 3 HOUR),
s1 AS (SELECT *, a + b * d0 + g * x1 AS d1 FROM x), s2 AS (SELECT *, a + b * d1 + g * x2 AS d2 FROM s1), s3 AS (SELECT *, a + b * d2 + g * x3 AS d3 FROM s2),
steps AS (SELECT series_id, fold, train_end, y0, 1::BIGINT AS h, y0 + d1 AS p FROM s3 UNION ALL SELECT series_id, fold, train_end, y0, 2, y0 + d1 + d2 FROM s3
          UNION ALL SELECT series_id, fold, train_end, y0, 3, y0 + d1 + d2 + d3 FROM s3)"""


@query("m10_exog_path", f"""WITH {EXOG_SQL}
SELECT series_id, 'ar_1_exog' AS model, fold, h, train_end + to_hours(h) AS ts, {R('p', 3)} AS y_pred,
  CASE WHEN y0 IS NULL THEN 'no row at the end of the training window' WHEN p IS NULL THEN 'no outside value at a step' END AS reason FROM steps""")
def exog_path(spark, sf):
    """A path whose outside column is known ahead: looked up for every (series, fold, step)."""
    h, folds = arima_inputs(spark, sf)
    events = table(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.count(F.lit(1)).cast("double").alias("external_events"))
    out = EXOG_MODEL.forecast_path(small_join(h, events, ["ts"]), HOURLY_PANEL, "value", folds, 3)
    return out.withColumn("y_pred", F.round(F.col("y_pred") + 2.3e-9, 3))
