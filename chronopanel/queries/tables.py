"""Sources and sinks: each query writes what Spark derived from the tables and reads it back."""

from pyspark.sql import functions as F

from chronopanel.operators import features
from chronopanel.operators.forecast import naive_baselines, naive_predictions
from chronopanel.plans.folds import fold_plan
from chronopanel.queries.base import (
    HOURLY_FOLDS, HOURLY_PANEL, HOURLY_SQL, LAGGED_SQL, PREDICTIONS_SQL, R, hourly, query, table,
)
from chronopanel.session import materialize, new_folder
from chronopanel.sources import observations as text, tables

TEXT_SQL = """SELECT event_type AS series_id, date_trunc('second', ts) AS ts,
  CASE WHEN value < 5 OR value > 100 THEN NULL ELSE value END AS value FROM events WHERE value < 200"""


def as_text(spark, sf):
    """Events as raw text: day-first dates, `?` for small values, words for large ones."""
    v = F.col("value")
    shown = F.when(v < 5, F.lit("?")).when(v > 100, F.lit("n/a")).otherwise(F.concat(F.lit(" "), v.cast("string"), F.lit(" ")))
    day = F.when(v >= 200, F.lit("not a date")).otherwise(F.date_format("ts", "d/M/yyyy"))
    return table(spark, sf, "events").select(
        F.col("event_type").alias(" SERIES_ID "), day.alias("DATE"), F.date_format("ts", "H:mm:ss").alias("time"), shown.alias("Value")
    )


@query("s1_delimited_scan", f"SELECT series_id, ts, {R('value')} AS value FROM ({TEXT_SQL})")
def delimited_scan(spark, sf):
    path = new_folder(spark, "files")
    as_text(spark, sf).write.mode("overwrite").option("header", True).option("sep", ";").csv(path)
    return text.read_observations(spark, path, measures=["value"], keys=["series_id"]).select("series_id", "ts", "value")


@query("s2_parse_times", """SELECT count(*) AS n_rows, count(*) FILTER (WHERE value >= 200) AS n_unparsed FROM events""")
def parse_times(spark, sf):
    src = text.match_columns(as_text(spark, sf), ["series_id", "Date", "Time", "value"])
    return text.parse_report(text.parse_times(src, "Date", "Time"))


@query("s3_numeric_coercion", f"""SELECT event_id, {R('CASE WHEN value BETWEEN 5 AND 100 THEN value END')} AS value FROM events""")
def numeric_coercion(spark, sf):
    v = F.col("value")
    shown = F.when(v < 5, F.lit("?")).when(v > 100, F.lit("NaN")).otherwise(F.concat(F.lit(" "), v.cast("string"), F.lit(" ")))
    return text.to_numbers(table(spark, sf, "events").select("event_id", shown.alias("value")), ["value"])


@query("s4_projected_scan", f"SELECT l_orderkey, l_linenumber, {R('l_extendedprice')} AS l_extendedprice FROM lineitem")
def projected_scan(spark, sf):
    return tables.read_table(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_extendedprice"])


def predictions(spark, sf):
    matrix, folds = stored_plan(spark, sf)
    return naive_predictions(matrix, HOURLY_PANEL, "value", folds, naive_baselines("value"))


def lag_matrix(spark, sf):
    return features.build_features(
        hourly(spark, sf), HOURLY_PANEL, "value", (1, 24, 168), (), calendar=False, cyclical=False, holidays=False
    )


def stored_plan(spark, sf):
    """The lag matrix, written once because folds, forecasts and scales all read it, and its folds."""
    matrix = materialize(lag_matrix(spark, sf))
    return matrix, fold_plan(matrix, HOURLY_PANEL, **HOURLY_FOLDS, strict=False).persist()


@query("s5_prediction_files", f"""WITH {PREDICTIONS_SQL} SELECT series_id, fold, model, ts, {R('y_true')} AS y_true, {R('y_pred')} AS y_pred
FROM preds WHERE model <> 'naive_lag_168h_weekly'""")
def prediction_files(spark, sf):
    """The weekly model lacks fold 2 and is left out as a whole."""
    path = new_folder(spark, "files")
    p = predictions(spark, sf)
    tables.write_predictions(p.filter(~((F.col("model") == "naive_lag_168h_weekly") & (F.col("fold") == 2))), path)
    return tables.read_predictions(spark, path, n_folds=HOURLY_FOLDS["n_folds"])


@query("s6_parquet_sink", f"WITH {LAGGED_SQL} SELECT series_id, ts, {R('value')} AS value, {R('l24')} AS value_lag_24h FROM matrix")
def parquet_sink(spark, sf):
    path = new_folder(spark, "files")
    tables.write_panel(lag_matrix(spark, sf), HOURLY_PANEL, path)
    return tables.read_panel(spark, path, months=["2024-01"]).select("series_id", "ts", "value", "value_lag_24h")


@query("s7_result_files", f"""WITH {HOURLY_SQL} SELECT series_id, count(*) AS n, {R('avg(value)')} AS mean_value, f AS fmt
FROM hourly, (VALUES ('csv'), ('json')) t(f) GROUP BY series_id, f""")
def result_files(spark, sf):
    path = new_folder(spark, "files")
    small = hourly(spark, sf).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))
    back = []
    for fmt in ("csv", "json"):
        tables.write_results(small, f"{path}/{fmt}", fmt)
        read = tables.read_results(spark, f"{path}/{fmt}", "series_id string, n bigint, mean_value double", fmt)
        back.append(read.withColumn("fmt", F.lit(fmt)))
    return back[0].unionByName(back[1])


@query("s8_provenance", f"""WITH {LAGGED_SQL} SELECT 'value' AS target_column, '1h' AS target_frequency, count(*) AS n_rows, CAST(3 AS BIGINT) AS n_features,
  strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts, true AS readable FROM matrix""")
def provenance(spark, sf):
    path, parameters = new_folder(spark, "files"), {"lags": [1, 24, 168], "target": "value"}
    meta = tables.save_features(lag_matrix(spark, sf), HOURLY_PANEL, "value", path, parameters)
    rows = tables.load_features(spark, path, parameters).agg(F.count(F.lit(1)).alias("stored"))
    at = lambda c: F.date_format(F.col(c).cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    # One row each.
    return meta.join(F.broadcast(rows), F.col("n_rows") == F.col("stored")).select(
        "target_column", "target_frequency", "n_rows", "n_features", at("date_range_start").alias("first_ts"),
        at("date_range_end").alias("last_ts"), F.lit(True).alias("readable"),
    )
