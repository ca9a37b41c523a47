"""Feature building, scalar functions, filters and the leakage guard."""

from pyspark.sql import functions as F

from chronopanel.functions import calendar
from chronopanel.operators import features, impute, profile
from chronopanel.operators.registry import Registry, default_registry
from chronopanel.operators.resample import resample
from chronopanel.plans.folds import fold_plan
from chronopanel.queries.base import (
    DAILY_PANEL, DAILY_SQL, FILLED_SQL, GAPPY_SQL, HOURLY_FOLDS, HOURLY_PANEL, HOURLY_SQL, LAGGED_SQL, QUARTER_PANEL, R, RAW_PANEL,
    by_user, daily, folds_sql, gappy, hourly, observations, query, table,
)
from chronopanel.session import materialize

ROLL_FRAME = "ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING"


def rolling_sql(windows, target="value", stats=("mean", "std", "min", "max")):
    fns = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
    out = []
    for n in windows:
        frame = f"(PARTITION BY series_id ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        for s in stats:
            agg = f"quantile_cont({target}, 0.5)" if s == "median" else f"{fns[s]}({target})"
            case = f"CASE WHEN count({target}) OVER {frame} = {n} THEN {agg} OVER {frame} END"
            out.append(f"{R(case)} AS {target}_roll_{s}_{n}h")
    return ", ".join(out)


def lags_sql(lags, target="value"):
    return ", ".join(
        f"{R(f'lag({target}, {n}) OVER (PARTITION BY series_id ORDER BY ts)')} AS {target}_lag_{n}h" for n in lags
    )


CALENDAR_SQL = """hour(ts) AS hour, isodow(ts) - 1 AS day_of_week, day(ts) AS day_of_month, dayofyear(ts) AS day_of_year,
  month(ts) AS month, quarter(ts) AS quarter, CAST(isodow(ts) >= 6 AS BIGINT) AS is_weekend"""


def cyclical_sql(decimals=6):
    phases = {"hour": "hour(ts) / 24.0", "day_of_week": "(isodow(ts) - 1) / 7.0", "month": "(month(ts) - 1) / 12.0"}
    return ", ".join(
        f"{R(f'CAST({fn}(2 * pi() * {p}) AS FLOAT)', decimals)} AS {n}_{fn}" for n, p in phases.items() for fn in ("sin", "cos")
    )


# Easter Sundays of the years in the test tables, for the comparison SQL only.
EASTER_SQL = """easter AS (SELECT * FROM (VALUES (1995, DATE '1995-04-16'), (1996, DATE '1996-04-07'), (1997, DATE '1997-03-30'),
  (1998, DATE '1998-04-12'), (1999, DATE '1999-04-04'), (2000, DATE '2000-04-23'), (2001, DATE '2001-04-15'),
  (2024, DATE '2024-03-31')) t(y, sunday)),
holidays AS (SELECT make_date(y, m, d) AS day FROM easter, (VALUES (1, 1), (5, 1), (5, 8), (7, 14), (8, 15), (11, 1), (11, 11), (12, 25)) f(m, d)
  UNION SELECT sunday + CAST(k AS INTEGER) FROM easter, (VALUES (1), (39), (50)) g(k))"""
HOLIDAY_SQL = "CAST(CAST(ts AS DATE) IN (SELECT day FROM holidays) AS BIGINT) AS is_french_holiday"


@query("w1_lag_features", f"WITH {HOURLY_SQL} SELECT series_id, ts, {R('value')} AS value, {lags_sql((1, 2, 3, 24, 48, 168))} FROM hourly")
def lag_features(spark, sf):
    return features.past_features(hourly(spark, sf), HOURLY_PANEL, "value", features.WIDE_LAGS, ())


@query("w1_lag_features_by_time", f"""WITH {HOURLY_SQL}
SELECT h.series_id, h.ts, {R('h.value')} AS value, {R('a.value')} AS value_lag_1h, {R('b.value')} AS value_lag_24h
FROM hourly h LEFT JOIN hourly a ON a.series_id = h.series_id AND a.ts = h.ts - INTERVAL 1 HOUR
LEFT JOIN hourly b ON b.series_id = h.series_id AND b.ts = h.ts - INTERVAL 24 HOUR""")
def lag_features_by_time(spark, sf):
    return features.past_features(hourly(spark, sf), HOURLY_PANEL, "value", (1, 24), (), mode="time")


@query("w1_lag_features_many_series", f"""WITH hourly AS (SELECT user_id AS series_id, date_trunc('hour', ts) AS ts, avg(value) AS value
  FROM events GROUP BY 1, 2) SELECT series_id, ts, {R('value')} AS value, {lags_sql((1, 24))} FROM hourly""")
def lag_features_many(spark, sf):
    return features.past_features(by_user(spark, sf), HOURLY_PANEL, "value", (1, 24), ())


@query("w2_rolling_stats", f"""WITH {FILLED_SQL}
SELECT series_id, ts, {R('value')} AS value, {rolling_sql((3, 24))} FROM filled""")
def rolling_stats(spark, sf):
    filled = impute.fill_gaps(gappy(spark, sf), QUARTER_PANEL, ["value", "high"])
    out = features.past_features(filled, QUARTER_PANEL, "value", (), (3, 24))
    return out.drop("high", "is_originally_missing", "is_outage_gap")


@query("w2_rolling_week", f"""WITH {HOURLY_SQL} SELECT series_id, ts, {R('value')} AS value, {rolling_sql((168,))} FROM hourly""")
def rolling_week(spark, sf):
    return features.past_features(hourly(spark, sf), HOURLY_PANEL, "value", (), (168,))


@query("w2_rolling_median", f"""WITH {HOURLY_SQL} SELECT series_id, ts, {R('value')} AS value,
  {rolling_sql((5,), stats=('median',))} FROM hourly""")
def rolling_median(spark, sf):
    return features.past_features(hourly(spark, sf), HOURLY_PANEL, "value", (), (5,), stats=("median",))


@query("w2_rolling_median_week", f"""WITH {HOURLY_SQL} SELECT series_id, ts, {R('value')} AS value,
  {rolling_sql((24, 168), stats=('mean', 'median'))} FROM hourly""")
def rolling_median_week(spark, sf):
    """Medians of long windows: each row adds a value to a sorted window and takes one out."""
    return features.past_features(hourly(spark, sf), HOURLY_PANEL, "value", (), (24, 168), stats=("mean", "median"))


@query("w2_rolling_by_time", f"""WITH {HOURLY_SQL}, r AS (SELECT series_id, ts, value,
  count(value) OVER f AS n, avg(value) OVER f AS m FROM hourly
  WINDOW f AS (PARTITION BY series_id ORDER BY ts RANGE BETWEEN INTERVAL 3 HOUR PRECEDING AND INTERVAL 1 HOUR PRECEDING))
SELECT series_id, ts, {R('value')} AS value, {R('CASE WHEN n = 3 THEN m END')} AS value_roll_mean_3h FROM r""")
def rolling_by_time(spark, sf):
    return features.past_features(hourly(spark, sf), HOURLY_PANEL, "value", (), (3,), ("mean",), mode="time")


@query("f1_calendar", f"SELECT event_id, {CALENDAR_SQL} FROM events")
def calendar_fields(spark, sf):
    return table(spark, sf, "events").select("event_id", *calendar.calendar_columns("ts"))


@query("f2_cyclical", f"SELECT event_id, {cyclical_sql()} FROM events")
def cyclical_fields(spark, sf):
    return table(spark, sf, "events").select("event_id", *calendar.cyclical_columns("ts"))


@query("f3_log1p", f"SELECT event_id, {R('ln(1 + value)')} AS log_value FROM events")
def log1p(spark, sf):
    return table(spark, sf, "events").select("event_id", F.log1p("value").alias("log_value"))


@query("f4_arithmetic", f"""SELECT event_id, {R('abs(value - 50)')} AS a, {R('sqrt(value)')} AS s, {R('value * value')} AS q,
  {R('greatest(least(value, 100), 10)')} AS clipped FROM events""")
def arithmetic(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select(
        "event_id", F.abs(v - 50).alias("a"), F.sqrt(v).alias("s"), (v * v).alias("q"),
        F.greatest(F.least(v, F.lit(100.0)), F.lit(10.0)).alias("clipped"),
    )


@query("f5_round", "SELECT l_orderkey, l_linenumber, round(l_extendedprice / 7, 4) + 0 AS r4 FROM lineitem")
def rounding(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") / 7, 4).alias("r4"))


@query("f6_strings", """SELECT event_id, lower(trim(' ' || event_type || ' ')) AS name, event_type || '_lag_' || CAST(user_id AS VARCHAR) AS label,
  starts_with(event_type, 'c') AS is_c FROM events""")
def strings(spark, sf):
    return table(spark, sf, "events").select(
        "event_id",
        F.lower(F.trim(F.concat(F.lit(" "), "event_type", F.lit(" ")))).alias("name"),
        F.concat_ws("_lag_", "event_type", F.col("user_id").cast("string")).alias("label"),
        F.startswith("event_type", F.lit("c")).alias("is_c"),
    )


@query("f7_zscore", f"""WITH {HOURLY_SQL}, s AS (SELECT series_id, avg(value) AS m, stddev_pop(value) + 1e-8 AS sd FROM hourly GROUP BY 1)
SELECT series_id, ts, {R('(value - m) / sd', 5)} AS z, {R('value')} AS back FROM hourly JOIN s USING (series_id)""")
def zscore(spark, sf):
    from chronopanel.plans.units import attach

    src = hourly(spark, sf)
    out = attach(src, HOURLY_PANEL, features.zscore_stats(src, ["series_id"], "value"))
    z = (F.col("value") - F.col("train_mean")) / F.col("train_std")
    return out.select("series_id", "ts", F.round(z, 5).alias("z"), features.denormalise(z).alias("back"))


@query("f8_date", "SELECT event_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day FROM events")
def dates(spark, sf):
    return table(spark, sf, "events").select("event_id", F.to_date("ts").alias("day"))


@query("f9_holiday_flag", f"WITH {DAILY_SQL}, {EASTER_SQL} SELECT series_id, ts, {HOLIDAY_SQL} FROM daily")
def holiday_flag(spark, sf):
    return daily(spark, sf).select("series_id", "ts", calendar.holiday_flag("ts"))


@query("j4_holiday_left_join", f"""WITH {DAILY_SQL}, {EASTER_SQL}
SELECT series_id, ts, {R('quantity')} AS quantity, CAST(day IS NOT NULL AS BIGINT) AS is_holiday
FROM daily LEFT JOIN holidays ON CAST(ts AS DATE) = day""")
def holiday_join(spark, sf):
    from chronopanel.plans.units import small_join

    src = daily(spark, sf).withColumn("holiday_date", F.to_date("ts"))
    dim = calendar.holiday_dates(src.select(F.col("holiday_date").alias("day"))).select("holiday_date", F.lit(1).alias("hit")).distinct()
    out = small_join(src, dim, ["holiday_date"], "left")
    return out.select("series_id", "ts", "quantity", F.col("hit").isNotNull().cast("bigint").alias("is_holiday"))


MATRIX_COLUMNS = f"""series_id, ts, {R('value')} AS value, is_originally_missing, is_outage_gap, {CALENDAR_SQL},
  {cyclical_sql()}, {lags_sql((1, 24, 168))}, {rolling_sql((3, 24, 168))}, {HOLIDAY_SQL}"""


@query("u3_feature_matrix", f"""WITH {FILLED_SQL}, {EASTER_SQL},
hourly AS (SELECT series_id, date_trunc('hour', ts) AS ts, avg(value) AS value,
       max(is_originally_missing) AS is_originally_missing, max(is_outage_gap) AS is_outage_gap FROM filled GROUP BY 1, 2
       HAVING avg(value) IS NOT NULL OR avg(high) IS NOT NULL),
full_matrix AS (SELECT {MATRIX_COLUMNS} FROM hourly)
SELECT * FROM full_matrix WHERE value IS NOT NULL AND value_lag_1h IS NOT NULL AND value_lag_24h IS NOT NULL
  AND value_lag_168h IS NOT NULL AND value_roll_mean_3h IS NOT NULL AND value_roll_mean_24h IS NOT NULL AND value_roll_mean_168h IS NOT NULL""")
def feature_matrix(spark, sf):
    """Gap policy, downsampling and all 31 features; ``high`` is a same-time column and is refused."""
    clean = impute.preprocess(gappy(spark, sf), QUARTER_PANEL, "1h", "mean", 3, ["value", "high"])
    return features.build_features(clean, HOURLY_PANEL, "value", registry=default_registry("value", unsafe=["high"]))


@query("p5_drop_warmup", f"""WITH {LAGGED_SQL} SELECT series_id, count(*) AS rows_before,
  count(*) FILTER (WHERE l168 IS NOT NULL) AS rows_after,
  {R('count(*) FILTER (WHERE l168 IS NOT NULL) * 100.0 / count(*)')} AS retained_pct FROM lagged GROUP BY 1""")
def drop_warmup(spark, sf):
    full = features.build_features(
        hourly(spark, sf), HOURLY_PANEL, "value", (1, 24, 168), (), calendar=False, cyclical=False, holidays=False,
        drop_incomplete=False,
    )
    return features.retention(full, HOURLY_PANEL, "value")


@query("p3_leakage_guard", f"""WITH {GAPPY_SQL}, h AS (SELECT series_id, date_trunc('hour', ts) AS ts, avg(value) AS value,
  max(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS is_originally_missing FROM gappy GROUP BY 1, 2 HAVING avg(value) IS NOT NULL OR avg(high) IS NOT NULL),
l AS (SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY ts) AS l1 FROM h)
SELECT 'is_originally_missing' AS feature, 'indicator' AS category, count(is_originally_missing) AS n FROM l
UNION ALL SELECT 'value_lag_1h', 'lag', count(l1) FROM l""")
def leakage_guard(spark, sf):
    """The refused column and the unregistered one are gone; the catalogue labels what is left."""
    registry = default_registry("value", unsafe=["high"])
    src = gappy(spark, sf).withColumn("is_originally_missing", F.col("value").isNull().cast("tinyint"))
    h = resample(src, QUARTER_PANEL, "1h", "mean", ["value", "high"], ["is_originally_missing"]).withColumn("novel", F.lit(1))
    out = features.build_features(
        h, HOURLY_PANEL, "value", (1,), (), calendar=False, cyclical=False, holidays=False, registry=registry,
        drop_incomplete=False,
    )
    names = features.feature_names(out, HOURLY_PANEL, "value")
    pairs = F.array(*[
        F.struct(F.lit(n).alias("feature"), F.lit(registry.find(n).category).alias("category"), F.col(n).isNotNull().alias("has"))
        for n in names
    ])
    return out.select(F.explode(pairs).alias("e")).groupBy("e.feature", "e.category").agg(F.count_if("e.has").alias("n"))


@query("x3_custom_registration", f"""WITH {HOURLY_SQL}, d AS (SELECT *, count(*) OVER (PARTITION BY series_id, CAST(ts AS DATE)) AS external_filled FROM hourly)
SELECT series_id, ts, {R('value')} AS value, external_filled, {lags_sql((1,))} FROM d QUALIFY lag(value) OVER (PARTITION BY series_id ORDER BY ts) IS NOT NULL""")
def custom_registration(spark, sf):
    """A registered prefix lets an outside column through the guard."""
    registry: Registry = default_registry("value").register("external_*", "external", True, "joined from outside")
    src = hourly(spark, sf)
    day = F.to_date("ts").alias("day")
    counts = src.groupBy("series_id", day).agg(F.count(F.lit(1)).alias("external_filled"))
    joined = src.withColumn("day", F.to_date("ts")).join(counts, ["series_id", "day"]).drop("day")
    return features.build_features(
        joined, HOURLY_PANEL, "value", (1,), (), calendar=False, cyclical=False, holidays=False, registry=registry
    )


@query("w15_sequence_windows", f"""WITH {HOURLY_SQL}, s AS (SELECT series_id, avg(value) AS m, stddev_pop(value) + 1e-8 AS sd FROM hourly GROUP BY 1),
z AS (SELECT series_id, ts, CAST((value - m) / sd AS FLOAT) AS z FROM hourly JOIN s USING (series_id)),
w AS (SELECT *, count(*) OVER f AS n, avg(z) OVER f AS history_mean, first_value(z) OVER f AS oldest, last_value(z) OVER f AS newest
      FROM z WINDOW f AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING))
SELECT series_id, ts, {R('z', 4)} AS next_value, {R('history_mean', 4)} AS history_mean, {R('oldest', 4)} AS oldest, {R('newest', 4)} AS newest
FROM w WHERE n = 168""")
def sequence_windows(spark, sf):
    out = features.sequence_samples(hourly(spark, sf), HOURLY_PANEL, "value", 168)
    h = F.col("history")
    mean = F.aggregate(h, F.lit(0.0), lambda a, x: a + x) / F.size(h)
    r4 = lambda c: F.round(c.cast("double"), 4)
    return out.select(
        "series_id", "ts", r4(F.col("next_value")).alias("next_value"), r4(mean).alias("history_mean"),
        r4(h[0]).alias("oldest"), r4(h[167]).alias("newest"),
    )


@query("w15_train_scaled", f"""WITH {HOURLY_SQL}, {folds_sql('hourly', 4, 8, 3)},
s AS (SELECT h.series_id, avg(value) AS m, stddev_pop(value) + 1e-8 AS sd FROM hourly h JOIN folds f ON f.series_id = h.series_id AND fold = 2
      AND h.ts BETWEEN f.train_start AND f.train_end GROUP BY 1),
z AS (SELECT series_id, ts, CAST((value - m) / sd AS FLOAT) AS z, m, sd FROM hourly JOIN s USING (series_id)),
w AS (SELECT *, count(*) OVER f AS n, avg(z) OVER f AS history_mean, first_value(z) OVER f AS oldest, last_value(z) OVER f AS newest
      FROM z WINDOW f AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING))
SELECT series_id, ts, {R('z', 3)} AS next_value, {R('history_mean', 3)} AS history_mean, {R('oldest', 3)} AS oldest, {R('newest', 3)} AS newest,
  {R('m')} AS train_mean, {R('sd')} AS train_std FROM w WHERE n = 48""")
def train_scaled(spark, sf):
    """Sequences under the mean and deviation of fold 2's training rows alone, as a backtest of that fold needs them."""
    h = materialize(hourly(spark, sf))
    folds = fold_plan(h, HOURLY_PANEL, **HOURLY_FOLDS, strict=False)
    out = features.sequence_samples(h, HOURLY_PANEL, "value", 48, features.training_stats(h, HOURLY_PANEL, "value", folds, 2))
    history = F.col("history")
    mean = F.aggregate(history, F.lit(0.0), lambda a, x: a + x) / F.size(history)
    r3 = lambda c: F.round(c.cast("double") + 2.3e-9, 3)
    return out.select("series_id", "ts", r3(F.col("next_value")).alias("next_value"), r3(mean).alias("history_mean"), r3(history[0]).alias("oldest"),
                      r3(history[47]).alias("newest"), "train_mean", "train_std")


@query("p1_time_range", f"""WITH {HOURLY_SQL} SELECT series_id, ts, {R('value')} AS value FROM hourly
WHERE ts BETWEEN TIMESTAMP '2024-01-08 00:00:00' AND TIMESTAMP '2024-01-15 12:00:00'""")
def time_range(spark, sf):
    return profile.time_range(hourly(spark, sf), HOURLY_PANEL, "2024-01-08 00:00:00", "2024-01-15 12:00:00")


@query("p2_day_slice", f"""SELECT event_id, event_type AS series_id, ts, {R('value')} AS value FROM events
WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-13'""")
def day_slice(spark, sf):
    src = table(spark, sf, "events").select("event_id", F.col("event_type").alias("series_id"), "ts", "value")
    return profile.day_range(src, RAW_PANEL, "2024-01-10", "2024-01-12")


@query("p2_last_week", f"""WITH e AS (SELECT event_type, max(CAST(ts AS DATE)) AS d FROM events GROUP BY 1)
SELECT v.event_type AS series_id, date_trunc('hour', v.ts) AS ts, {R('avg(v.value)')} AS value
FROM events v JOIN e USING (event_type) WHERE v.ts >= d - 7 AND v.ts < d + 1 GROUP BY 1, 2""")
def last_week(spark, sf):
    return resample(profile.trailing_days(observations(spark, sf), RAW_PANEL, days=7), RAW_PANEL, "1h", "mean", ["value"])


@query("p2_last_month_daily", f"""WITH {DAILY_SQL}, e AS (SELECT series_id, max(CAST(ts AS DATE)) AS d FROM daily GROUP BY 1)
SELECT series_id, ts, {R('value')} AS value, {R('quantity')} AS quantity FROM daily JOIN e USING (series_id)
WHERE ts >= d - INTERVAL 1 MONTH AND ts < d + INTERVAL 1 DAY""")
def last_month(spark, sf):
    return profile.trailing_days(daily(spark, sf), DAILY_PANEL, months=1)


@query("p6_tail_filter", "SELECT event_type AS series_id, count(*) FILTER (WHERE value > 100) AS n_above FROM events GROUP BY 1")
def tail_filter(spark, sf):
    return observations(spark, sf).groupBy("series_id").agg(F.count_if(F.col("value") > 100).alias("n_above"))


@query("p7_clip_at_zero", f"SELECT event_id, {R('greatest(value - 20, 0)')} AS clipped FROM events")
def clip(spark, sf):
    return table(spark, sf, "events").select("event_id", F.greatest(F.col("value") - 20, F.lit(0.0)).alias("clipped"))


@query("p9_scenario", f"""SELECT event_type AS series_id, {R('avg(value)')} AS original_mean, {R('avg(value) * 1.2')} AS scenario_mean,
  {R('avg(value) * 1.2 - avg(value)')} AS impact, {R('(avg(value) * 1.2 - avg(value)) * 100 / avg(value)')} AS impact_pct FROM events GROUP BY 1""")
def scenario(spark, sf):
    return profile.scenario(observations(spark, sf), ["series_id"], "value", 1.2)
