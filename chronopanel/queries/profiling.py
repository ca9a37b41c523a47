"""Segment profiles, distributions, rolling views, decomposition."""

from pyspark.sql import functions as F

from chronopanel.operators.loess import decompose_stl, loess
from chronopanel.operators import profile, quality
from chronopanel.queries.base import (
    DAILY_PANEL, DAILY_SQL, GAPPY_SQL, GAPS_SQL, HOURLY_PANEL, HOURLY_SQL, QUARTER_PANEL, R, RAW_PANEL, by_user, daily,
    gappy, hourly, observations, query, table,
)

SEGMENT_SQL = {"hour": "hour(ts)", "day_of_week": "isodow(ts) - 1", "month": "month(ts)"}


@query("a9_segment_profile", f"WITH {HOURLY_SQL} " + " UNION ALL ".join(
    f"""SELECT series_id, '{n}' AS segment, {e} AS segment_value, {R('avg(value)')} AS mean, {R('stddev_samp(value)')} AS std,
  {R('min(value)')} AS "min", {R('max(value)')} AS "max" FROM hourly GROUP BY ALL""" for n, e in SEGMENT_SQL.items()))
def segment_profile(spark, sf):
    return profile.segment_profile(hourly(spark, sf), HOURLY_PANEL, "value", decimals=None)


@query("a10_heat_table", f"WITH {HOURLY_SQL} SELECT series_id, isodow(ts) - 1 AS day_of_week, " + ", ".join(
    f"{R(f'avg(value) FILTER (WHERE hour(ts) = {h})')} AS h{h}" for h in range(24)) + " FROM hourly GROUP BY 1, 2")
def heat_table(spark, sf):
    return profile.heat_table(hourly(spark, sf), HOURLY_PANEL, "value")


def skew_sql(v: str) -> str:
    m = f"avg({v})"
    third = f"(avg(({v}) * ({v}) * ({v})) - 3 * {m} * avg(({v}) * ({v})) + 2 * {m} * {m} * {m})"
    return f"{third} / (stddev_pop({v}) * var_pop({v}))"


@query("a11_moments", f"""WITH {HOURLY_SQL} SELECT series_id, count(value) AS n, {R(skew_sql('value'))} AS skew,
  {R('kurtosis_pop(value)')} AS kurt, {R(skew_sql('ln(1 + value)'))} AS skew_log, {R('kurtosis_pop(ln(1 + value))')} AS kurt_log,
  {R('max(value)')} AS "max", count(*) FILTER (WHERE value > 100) AS n_above FROM hourly GROUP BY 1""")
def moments(spark, sf):
    return profile.moments(hourly(spark, sf), ["series_id"], "value", above=100)


@query("a11_tail_quantiles", f"""SELECT event_type AS series_id, p, {R('quantile')} AS quantile FROM (
  SELECT event_type, unnest([0.95, 0.99, 0.999]::DOUBLE[]) AS p, unnest(quantile_cont(value, [0.95, 0.99, 0.999])) AS quantile
  FROM events GROUP BY 1)""")
def tail_quantiles(spark, sf):
    return profile.tail_quantiles(observations(spark, sf), ["series_id"], "value")


def histogram_sql(source: str, value: str, bins: int, unlog: bool = False) -> str:
    e = (lambda x: f"pow(10, {x})") if unlog else (lambda x: x)
    return f"""v AS (SELECT series_id, {value} AS v FROM {source}),
ends AS (SELECT series_id, min(v) AS lo, max(v) AS hi FROM v GROUP BY 1),
placed AS (SELECT series_id, lo, (hi - lo) / {bins} AS w,
  CASE WHEN hi > lo THEN least(floor((v - lo) / ((hi - lo) / {bins})) + 1, {bins}) ELSE 1 END AS bin
  FROM v JOIN ends USING (series_id) WHERE v IS NOT NULL)
SELECT series_id, CAST(bin AS BIGINT) AS bin, {R(e('(lo + (bin - 1) * w)'))} AS lower, {R(e('(lo + (bin - 1) * w + w)'))} AS upper,
  count(*) AS n FROM placed GROUP BY series_id, bin, lo, w"""


@query("a12_histogram", "WITH v0 AS (SELECT event_type AS series_id, value FROM events), " + histogram_sql("v0", "value", 80))
def histogram(spark, sf):
    return profile.histogram(observations(spark, sf), RAW_PANEL, "value", 80)


@query("a12_histogram_log1p", "WITH v0 AS (SELECT event_type AS series_id, value FROM events), " + histogram_sql("v0", "ln(1 + value)", 80))
def histogram_log(spark, sf):
    return profile.histogram(observations(spark, sf), RAW_PANEL, F.log1p("value"), 80)


@query("a12_gap_length_histogram", f"WITH {GAPS_SQL}, " + histogram_sql("gaps", "length", 40))
def gap_histogram(spark, sf):
    gaps = quality.gap_summary(gappy(spark, sf), QUARTER_PANEL, ["value", "high"]).withColumnRenamed("start", "ts")
    return profile.histogram(gaps, QUARTER_PANEL, "length", 40)


@query("a12_gap_length_log_histogram", f"WITH {GAPS_SQL}, " + histogram_sql("gaps", "log10(length)", 40, unlog=True))
def gap_log_histogram(spark, sf):
    gaps = quality.gap_summary(gappy(spark, sf), QUARTER_PANEL, ["value", "high"]).withColumnRenamed("start", "ts")
    return profile.histogram(gaps, QUARTER_PANEL, "length", 40, log_bins=True)


# Acklam's rational approximation of the inverse normal distribution, as published.
NORM_TAIL = ("((((((-7.784894002430293e-03 * {r} - 3.223964580411365e-01) * {r} - 2.400758277161838e+00) * {r} - 2.549732539343734e+00) * {r} + 4.374664141464968e+00) * {r}"
             " + 2.938163982698783e+00) / ((((7.784695709041462e-03 * {r} + 3.224671290700398e-01) * {r} + 2.445134137142996e+00) * {r} + 3.754408661907416e+00) * {r} + 1))")
NORM_MIDDLE = ("((((((-3.969683028665376e+01 * {r} + 2.209460984245205e+02) * {r} - 2.759285104469687e+02) * {r} + 1.383577518672690e+02) * {r} - 3.066479806614716e+01) * {r}"
               " + 2.506628277459239e+00) * {q} / (((((-5.447609879822406e+01 * {r} + 1.615858368580409e+02) * {r} - 1.556989798598866e+02) * {r} + 6.680131188771972e+01) * {r}"
               " - 1.328068155288572e+01) * {r} + 1))")


def norm_quantile_sql(p: str) -> str:
    low, high = (NORM_TAIL.format(r=f"sqrt(-2 * ln({x}))") for x in (p, f"1 - {p}"))
    middle = NORM_MIDDLE.format(r=f"(({p} - 0.5) * ({p} - 0.5))", q=f"({p} - 0.5)")
    return f"CASE WHEN {p} < 0.02425 THEN {low} WHEN {p} > 0.97575 THEN -{high} ELSE {middle} END"


@query("a13_normal_qq", f"""WITH r AS (SELECT event_type AS series_id, ts, value, row_number() OVER (PARTITION BY event_type ORDER BY value, ts) AS rank,
  count(*) OVER (PARTITION BY event_type) AS n FROM events),
q AS (SELECT *, CASE WHEN rank = n THEN pow(0.5, 1.0 / n) WHEN rank = 1 THEN 1 - pow(0.5, 1.0 / n)
                ELSE CAST(rank - 0.3175 AS DOUBLE) / CAST(n + 0.365 AS DOUBLE) END AS p FROM r)
SELECT series_id, ts, rank, {R('value')} AS ordered, {R(norm_quantile_sql('p'))} AS theoretical FROM q""")
def normal_qq(spark, sf):
    return profile.qq_pairs(observations(spark, sf), RAW_PANEL, "value")


@query("a14_describe", f"WITH {GAPPY_SQL} " + " UNION ALL ".join(
    f"""SELECT series_id, '{c}' AS column_name, count({c}) AS "count", {R(f'count({c}) / count(*)')} AS coverage, {R(f'avg({c})')} AS mean,
  {R(f'stddev_samp({c})')} AS std, {R(f'min({c})')} AS "min", {R(f'max({c})')} AS "max", {R(f'quantile_cont({c}, 0.25)')} AS q25,
  {R(f'quantile_cont({c}, 0.5)')} AS q50, {R(f'quantile_cont({c}, 0.75)')} AS q75 FROM gappy GROUP BY 1""" for c in ("value", "high")))
def describe(spark, sf):
    return profile.describe(gappy(spark, sf), ["series_id"], ["value", "high"])


@query("a15_kpis", f"""SELECT event_type AS series_id, {R('avg(value)')} AS mean, {R('max(value)')} AS peak, {R('min(value)')} AS low,
  {R('sum(value)')} AS total FROM events GROUP BY 1""")
def kpis(spark, sf):
    return profile.kpis(observations(spark, sf), ["series_id"], "value")


@query("a26_weekend_gap", f"""WITH {DAILY_SQL}, s AS (SELECT series_id, avg(quantity) FILTER (WHERE isodow(ts) >= 6) AS we,
  avg(quantity) FILTER (WHERE isodow(ts) < 6) AS wd, max(quantity) AS mx, avg(quantity) AS av FROM daily GROUP BY 1)
SELECT series_id, {R('we')} AS weekend_mean, {R('wd')} AS weekday_mean, {R('(we - wd) * 100 / wd')} AS diff_pct, {R('mx / av')} AS peak_ratio FROM s""")
def weekend_gap(spark, sf):
    return profile.weekend_gap(daily(spark, sf), DAILY_PANEL, "quantity")


@query("a27_extremes", f"""WITH {DAILY_SQL} SELECT series_id, {R('avg(quantity)')} AS mean, {R('max(quantity)')} AS peak,
  arg_max(ts, (quantity, -epoch(ts))) AS peak_at, {R('min(quantity)')} AS trough, arg_min(ts, (quantity, epoch(ts))) AS trough_at
FROM daily GROUP BY 1""")
def extremes(spark, sf):
    return profile.extremes(daily(spark, sf), DAILY_PANEL, "quantity")


@query("w5_first_difference", f"""WITH {HOURLY_SQL} SELECT series_id, ts, {R('value')} AS value,
  {R('value - lag(value) OVER (PARTITION BY series_id ORDER BY ts)')} AS diff FROM hourly""")
def first_difference(spark, sf):
    return profile.difference(hourly(spark, sf), HOURLY_PANEL, "value")


@query("w6_trailing_week", f"""WITH {HOURLY_SQL}, r AS (SELECT series_id, ts, value, count(value) OVER f AS n, avg(value) OVER f AS m,
  stddev_samp(value) OVER f AS s FROM hourly WINDOW f AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 167 PRECEDING AND CURRENT ROW))
SELECT series_id, ts, {R('value')} AS value, {R('CASE WHEN n >= 84 THEN m END')} AS roll_mean_168, {R('CASE WHEN n >= 84 THEN s END')} AS roll_std_168 FROM r""")
def trailing_week(spark, sf):
    return profile.trailing_stats(hourly(spark, sf), HOURLY_PANEL, "value", 168)


@query("w7_moving_average", f"""WITH {DAILY_SQL}, r AS (SELECT series_id, ts, quantity, count(quantity) OVER f AS n, avg(quantity) OVER f AS m
  FROM daily WINDOW f AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
SELECT series_id, ts, {R('quantity')} AS quantity, {R('CASE WHEN n = 7 THEN m END')} AS ma_7 FROM r""")
def moving_average(spark, sf):
    return profile.moving_average(daily(spark, sf).drop("value"), DAILY_PANEL, "quantity", 7)


DECOMPOSE_SQL = HOURLY_SQL + """,
idx AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS i FROM hourly),
ma AS (SELECT *, CASE WHEN count(value) OVER f = 25 THEN
    (sum(value) OVER f - (lag(value, 12) OVER w + lead(value, 12) OVER w) / 2) / 24 END AS trend
  FROM idx WINDOW w AS (PARTITION BY series_id ORDER BY ts),
       f AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)),
phase AS (SELECT series_id, i % 24 AS p, avg(value - trend) AS m FROM ma GROUP BY 1, 2),
season AS (SELECT series_id, p, m - avg(m) OVER (PARTITION BY series_id) AS seasonal FROM phase),
parts AS (SELECT ma.series_id, ts, value, trend, seasonal, value - trend - seasonal AS remainder
  FROM ma JOIN season s ON ma.series_id = s.series_id AND ma.i % 24 = s.p)"""


@query("w11_decomposition", f"""WITH {DECOMPOSE_SQL} SELECT series_id, ts, {R('value')} AS value, {R('trend')} AS trend,
  {R('seasonal')} AS seasonal, {R('remainder')} AS remainder FROM parts""")
def decomposition(spark, sf):
    return profile.decompose(hourly(spark, sf), HOURLY_PANEL, "value", 24)


@query("w11_decomposition_summary", f"""WITH {DECOMPOSE_SQL} SELECT series_id, {R('max(seasonal) - min(seasonal)')} AS seasonal_amplitude,
  {R('min(trend)')} AS trend_min, {R('max(trend)')} AS trend_max, {R('stddev_samp(remainder)')} AS remainder_std FROM parts GROUP BY 1""")
def decomposition_summary(spark, sf):
    return profile.decomposition_summary(profile.decompose(hourly(spark, sf), HOURLY_PANEL, "value", 24), ["series_id"])


# A line through the 25 nearest rows: weighted means, then slope, all as sums over the window.
LOESS_SQL = HOURLY_SQL + """,
r AS (SELECT series_id, ts, value, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM hourly),
c AS (SELECT *, least(greatest(i - 12, 0), n - 25) AS lo FROM r),
j AS (SELECT c.series_id, c.ts, c.value, c.i, c.n, b.i AS x, b.value AS y, abs(b.i - c.i) / greatest(c.i - c.lo, c.lo + 24 - c.i)::DOUBLE AS d
      FROM c JOIN r b ON b.series_id = c.series_id AND b.i BETWEEN c.lo AND c.lo + 24),
k AS (SELECT *, CASE WHEN d <= 0.001 THEN 1 WHEN d <= 0.999 THEN power(1 - power(d, 3), 3) ELSE 0 END AS w FROM j),
m AS (SELECT series_id, ts, any_value(value) AS value, any_value(i) AS i, sum(w) AS s, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM k GROUP BY 1, 2),
l AS (SELECT k.series_id, k.ts, sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) * (x - mx)) AS slope FROM k JOIN m USING (series_id, ts) GROUP BY 1, 2)"""


@query("w11_loess", f"WITH {LOESS_SQL} SELECT series_id, ts, {R('value')} AS value, {R('my + slope * (i - mx)')} AS smooth FROM m JOIN l USING (series_id, ts)")
def local_regression(spark, sf):
    """One pass of the smoother that the robust decomposition repeats."""
    return loess(hourly(spark, sf), HOURLY_PANEL, "value", 25)


@query("w11_stl")
def robust_decomposition(spark, sf):
    """Trend, season and remainder by local regression, with 15 rounds of robustness weights."""
    return decompose_stl(hourly(spark, sf), HOURLY_PANEL, "value")


@query("a28_inside_outside", f"""WITH {DECOMPOSE_SQL} SELECT series_id,
  ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12' AS inside, {R('avg(abs(remainder))')} AS abs_mean,
  {R('stddev_samp(remainder)')} AS std, count(remainder) AS n FROM parts GROUP BY 1, 2""")
def inside_outside(spark, sf):
    from chronopanel.operators.evaluate import inside_outside as summary

    parts = profile.decompose(hourly(spark, sf), HOURLY_PANEL, "value", 24)
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return summary(parts, ["series_id"], "ts", "remainder", at("2024-01-10"), at("2024-01-12"))


@query("w12_anomaly_flag", f"""WITH t AS (SELECT event_type, avg(value) + 2 * stddev_samp(value) AS threshold FROM events GROUP BY 1)
SELECT event_type AS series_id, ts, {R('value')} AS value, {R('threshold')} AS threshold, CAST(value > threshold AS BIGINT) AS is_anomaly
FROM events JOIN t USING (event_type)""")
def anomaly_flag(spark, sf):
    return profile.anomalies(observations(spark, sf), RAW_PANEL, "value")


@query("w12_anomaly_count_many_series", """WITH h AS (SELECT user_id AS series_id, date_trunc('hour', ts) AS ts, avg(value) AS value FROM events GROUP BY 1, 2),
t AS (SELECT series_id, avg(value) + 2 * stddev_samp(value) AS threshold FROM h GROUP BY 1)
SELECT series_id, CAST(count(*) FILTER (WHERE value > threshold) AS BIGINT) AS n_anomalies FROM h JOIN t USING (series_id) GROUP BY 1""")
def anomaly_count(spark, sf):
    flagged = profile.anomalies(by_user(spark, sf), HOURLY_PANEL, "value")
    return flagged.groupBy("series_id").agg(F.sum("is_anomaly").cast("bigint").alias("n_anomalies"))


@query("o1_sorted_by_time", f"WITH {HOURLY_SQL} SELECT series_id, ts, {R('value')} AS value FROM hourly ORDER BY series_id, ts")
def sorted_by_time(spark, sf):
    return hourly(spark, sf).orderBy("series_id", "ts")


@query("o2_top_hours", f"""SELECT hour(ts) AS hour, {R('avg(value)')} AS mean_value FROM events GROUP BY 1 ORDER BY avg(value) DESC, 1 LIMIT 5""")
def top_hours(spark, sf):
    means = table(spark, sf, "events").groupBy(F.hour("ts").alias("hour")).agg(F.avg("value").alias("mean_value"))
    return means.orderBy(F.col("mean_value").desc(), "hour").limit(5)
