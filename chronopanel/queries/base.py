"""Registration, the panels the queries share, and SQL fragments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.operators.resample import resample
from chronopanel.panel import Panel
from chronopanel.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

HOURLY_PANEL = Panel(freq="1h")
QUARTER_PANEL = Panel(freq="15min")
DAILY_PANEL = Panel(freq="1D")
RAW_PANEL = Panel(freq="1min")


def query(name: str, sql: str | None = None):
    """Register a query; its result is rounded and its integers widened for comparison."""

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(fn(prepare(spark), sf_dir))

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


# Means of two-decimal values often end in a 5 after six decimals. The two engines add
# in different orders, so such ties would round either way; this offset settles them.
TIE = 2.3e-9


def tidy(df: DataFrame, decimals: int = 6) -> DataFrame:
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            c = F.round(c.cast("double") + F.lit(TIE), decimals)
        elif kind in ("tinyint", "smallint", "int"):
            c = c.cast("bigint")
        elif kind in ("date", "timestamp"):
            c = c.cast("timestamp_ntz")
        out.append(c.alias(name))
    return df.select(*out)


def R(expr: str, decimals: int = 6) -> str:
    """The SQL side of `tidy` for one floating-point expression."""
    return f"(round(CAST({expr} AS DOUBLE) + {TIE}, {decimals}) + 0)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- panels ---------------------------------------------------------------------

def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Irregular panel: one series per event type."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), "ts", "value")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(observations(spark, sf_dir), RAW_PANEL, "1h", "mean", ["value"])


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense 15-minute grid with two measures, null where nothing was observed."""
    obs = observations(spark, sf_dir).withColumn("high", F.when(F.col("value") >= 10, F.col("value")))
    return resample(obs, RAW_PANEL, "15min", "mean", ["value", "high"], dense=True)


def by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many-series panel: hourly mean per user."""
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("series_id"), "ts", "value")
    return resample(users, RAW_PANEL, "1h", "mean", ["value"])


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long daily panel: mean price and total quantity per return flag."""
    items = table(spark, sf_dir, "lineitem")
    return items.groupBy(F.col("l_returnflag").alias("series_id"), F.col("l_shipdate").alias("ts")).agg(
        F.avg("l_extendedprice").alias("value"), F.sum("l_quantity").alias("quantity")
    )


OBS_SQL = "obs AS (SELECT event_type AS series_id, ts, value FROM events)"
HOURLY_SQL = """hourly AS (
  SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, avg(value) AS value FROM events GROUP BY 1, 2)"""
GAPPY_SQL = """buckets AS (
  SELECT event_type AS series_id, time_bucket(INTERVAL '15 minutes', ts) AS ts, avg(value) AS value,
         avg(value) FILTER (WHERE value >= 10) AS high FROM events GROUP BY 1, 2),
spans AS (SELECT series_id, min(ts) AS lo, max(ts) AS hi FROM buckets GROUP BY 1),
grid AS (SELECT series_id, unnest(generate_series(lo, hi, INTERVAL '15 minutes')) AS ts FROM spans),
gappy AS (SELECT g.series_id, g.ts, b.value, b.high FROM grid g LEFT JOIN buckets b USING (series_id, ts))"""
GAPS_SQL = GAPPY_SQL + """,
marked AS (SELECT *, (value IS NULL OR high IS NULL) AS missing,
                  row_number() OVER (PARTITION BY series_id ORDER BY ts) AS rn FROM gappy),
islands AS (SELECT *, rn - row_number() OVER (PARTITION BY series_id, missing ORDER BY ts) AS island FROM marked),
gaps AS (SELECT series_id, min(ts) AS "start", max(ts) AS "end", count(*) AS length
         FROM islands WHERE missing GROUP BY series_id, island)"""
FILLED_SQL = GAPS_SQL + """,
runs AS (SELECT *, CASE WHEN missing THEN count(*) OVER (PARTITION BY series_id, missing, island) ELSE 0 END AS gap_length
         FROM islands),
lasts AS (SELECT *, last_value(value IGNORE NULLS) OVER w AS fill_value, last_value(high IGNORE NULLS) OVER w AS fill_high
          FROM runs WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
filled AS (SELECT series_id, ts,
                  CASE WHEN gap_length > 3 THEN NULL ELSE fill_value END AS value,
                  CASE WHEN gap_length > 3 THEN NULL ELSE fill_high END AS high,
                  CAST(missing AS BIGINT) AS is_originally_missing,
                  CAST(gap_length > 3 AS BIGINT) AS is_outage_gap
           FROM lasts)"""
DAILY_SQL = """daily AS (
  SELECT l_returnflag AS series_id, l_shipdate AS ts, avg(l_extendedprice) AS value, sum(l_quantity) AS quantity
  FROM lineitem GROUP BY 1, 2)"""

# The backtest on the hourly panel: 4 folds of 8 training and 3 validation days.
HOURLY_FOLDS = {"n_folds": 4, "train_days": 8, "valid_days": 3, "gap_days": 0}


def folds_sql(source: str, n: int, train: int, valid: int, gap: int = 0, step: str = "1 hour") -> str:
    return f"""span AS (SELECT series_id, min(ts) AS lo, max(ts) AS hi FROM {source} GROUP BY 1),
ends AS (SELECT series_id, k AS fold, hi - to_days(CAST(({n} - k) * {valid} AS INTEGER)) AS valid_end
         FROM span, (SELECT unnest(generate_series(1, {n})) AS k)
         WHERE epoch(hi) - epoch(lo) >= {(train + n * valid + gap) * 86400}),
starts AS (SELECT *, valid_end - to_days({valid}) + INTERVAL '{step}' AS valid_start FROM ends),
tails AS (SELECT *, valid_start - INTERVAL '{step}' - to_days({gap}) AS train_end FROM starts),
folds AS (SELECT series_id, CAST(fold AS BIGINT) AS fold, train_end - to_days({train}) + INTERVAL '{step}' AS train_start,
                 train_end, valid_start, valid_end FROM tails)"""


LAGGED_SQL = HOURLY_SQL + """,
lagged AS (SELECT series_id, ts, value, lag(value, 1) OVER w AS l1, lag(value, 24) OVER w AS l24,
                  lag(value, 168) OVER w AS l168
           FROM hourly WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
matrix AS (SELECT * FROM lagged WHERE l168 IS NOT NULL)"""
PREDICTIONS_SQL = LAGGED_SQL + ",\n" + folds_sql("matrix", 4, 8, 3) + """,
valid AS (SELECT m.*, f.fold FROM matrix m JOIN folds f
          ON m.series_id = f.series_id AND m.ts BETWEEN f.valid_start AND f.valid_end),
preds AS (SELECT series_id, fold, ts, value AS y_true, 'naive_lag_1h' AS model, l1 AS y_pred FROM valid
          UNION ALL SELECT series_id, fold, ts, value, 'naive_lag_24h_daily', l24 FROM valid
          UNION ALL SELECT series_id, fold, ts, value, 'naive_lag_168h_weekly', l168 FROM valid)"""
SCALE_SQL = """train AS (SELECT m.series_id, f.fold, m.ts, m.value,
                 abs(m.value - lag(m.value, 24) OVER (PARTITION BY m.series_id, f.fold ORDER BY m.ts)) AS d
          FROM matrix m JOIN folds f ON m.series_id = f.series_id AND m.ts BETWEEN f.train_start AND f.train_end),
scales AS (SELECT series_id, fold, avg(d) AS scale FROM train GROUP BY 1, 2)"""
SCORES_SQL = PREDICTIONS_SQL + ",\n" + SCALE_SQL + """,
raw_scores AS (SELECT series_id, fold, model, count(*) AS valid_rows, avg(abs(y_true - y_pred)) AS mae,
       sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS rmse,
       sum(abs(y_true - y_pred)) / sum(abs(y_true)) AS wape,
       avg(CASE WHEN abs(y_true) + abs(y_pred) = 0 THEN 0
                ELSE abs(y_true - y_pred) / ((abs(y_true) + abs(y_pred)) / 2) END) AS smape
  FROM preds GROUP BY 1, 2, 3),
scores AS (SELECT r.*, r.mae / s.scale AS mase FROM raw_scores r JOIN scales s USING (series_id, fold))"""
