"""Comparing models: alignment, segments, significance, stacking."""

from pyspark.sql import functions as F

from chronopanel.operators import ensemble, evaluate
from chronopanel.queries.backtests import MODELS, fold_scores
from chronopanel.queries.base import (
    HOURLY_FOLDS, HOURLY_PANEL, PREDICTIONS_SQL, R, SCORES_SQL, hourly, query, table,
)
from chronopanel.queries.tables import predictions
from chronopanel.session import materialize

WIDE_SQL = PREDICTIONS_SQL + """,
wide AS (SELECT series_id, fold, ts, max(y_true) AS y_true, max(y_pred) FILTER (WHERE model = 'naive_lag_1h') AS a,
  max(y_pred) FILTER (WHERE model = 'naive_lag_24h_daily') AS b, max(y_pred) FILTER (WHERE model = 'naive_lag_168h_weekly') AS c
  FROM preds GROUP BY 1, 2, 3)"""


@query("j2_aligned_models", f"""WITH {WIDE_SQL} SELECT series_id, fold, ts, {R('y_true')} AS y_true, {R('a')} AS naive_lag_1h,
  {R('b')} AS naive_lag_24h_daily, {R('c')} AS naive_lag_168h_weekly FROM wide""")
def aligned_models(spark, sf):
    return evaluate.align_models(predictions(spark, sf), MODELS)


@query("j5_truth_joined_back", f"""WITH {PREDICTIONS_SQL}, t AS (SELECT DISTINCT series_id, fold, ts, y_true FROM preds),
p AS (SELECT series_id, fold, ts, avg(y_pred) AS mean_pred FROM preds GROUP BY 1, 2, 3)
SELECT series_id, fold, ts, {R('mean_pred')} AS mean_pred, {R('y_true')} AS y_true FROM p JOIN t USING (series_id, fold, ts)""")
def truth_joined_back(spark, sf):
    p = predictions(spark, sf)
    on = ["series_id", "fold", "ts"]
    truth = p.select(*on, "y_true").dropDuplicates()
    return p.groupBy(*on).agg(F.avg("y_pred").alias("mean_pred")).join(truth, on)


@query("j3_compare_runs", f"""WITH {SCORES_SQL} SELECT a.series_id, a.fold, {R('a.mae')} AS "MAE_base", {R('b.mae')} AS "MAE_other",
  {R('b.mae - a.mae')} AS delta, {R('(b.mae - a.mae) * 100 / a.mae')} AS delta_pct FROM raw_scores a JOIN raw_scores b
  ON a.series_id = b.series_id AND a.fold = b.fold WHERE a.model = 'naive_lag_1h' AND b.model = 'naive_lag_24h_daily'""")
def compare_runs(spark, sf):
    scores = evaluate.score(predictions(spark, sf), ["series_id", "fold", "model"])
    pick = lambda m: scores.filter(F.col("model") == m)
    return evaluate.compare_runs(pick(MODELS[0]), pick(MODELS[1]), ["series_id", "fold"])


@query("j7_membership", """SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def membership(spark, sf):
    urgent = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").join(urgent, "l_orderkey", "left_semi")


SEGMENTS = {"hour": ("hour(ts)", range(24)), "dow": ("isodow(ts) - 1", range(7)), "month": ("month(ts)", range(1, 13))}


def segment_sql(segment: str) -> str:
    expr, values = SEGMENTS[segment]
    cells = ", ".join(f"{R(f'avg(abs(y_true - y_pred)) FILTER (WHERE {expr} = {v})', 4)} AS {segment}_{v}" for v in values)
    return f"WITH {PREDICTIONS_SQL} SELECT model, {cells} FROM preds GROUP BY 1"


@query("a20_mae_by_hour", segment_sql("hour"))
def mae_by_hour(spark, sf):
    return evaluate.segment_table(predictions(spark, sf), "hour")


@query("a20_mae_by_dow", segment_sql("dow"))
def mae_by_dow(spark, sf):
    return evaluate.segment_table(predictions(spark, sf), "dow")


@query("a20_mae_by_month", segment_sql("month"))
def mae_by_month(spark, sf):
    return evaluate.segment_table(predictions(spark, sf), "month")


@query("a21_segment_metrics", f"WITH {PREDICTIONS_SQL} " + " UNION ALL ".join(
    f"""SELECT '{n}' AS segment, {e} AS segment_value, fold, model, {R('avg(abs(y_true - y_pred))')} AS "MAE",
  {R('sqrt(avg((y_true - y_pred) * (y_true - y_pred)))')} AS "RMSE", {R('avg(abs(y_true - y_pred) / greatest(abs(y_true), 1e-6)) * 100')} AS "MAPE",
  {R('avg(CASE WHEN abs(y_true) + abs(y_pred) = 0 THEN 0 ELSE abs(y_true - y_pred) / ((abs(y_true) + abs(y_pred)) / 2) END) * 100')} AS "sMAPE",
  count(*) AS n FROM preds GROUP BY ALL"""
    for n, e in (("hour", "hour(ts)"), ("day_of_week", "isodow(ts) - 1"), ("month", "month(ts)"))))
def segment_metrics(spark, sf):
    return evaluate.segment_metrics(predictions(spark, sf))


def dm_sql() -> str:
    cols = dict(zip(MODELS, "abc"))
    pairs = [(x, y) for x in MODELS for y in MODELS if x != y]
    return f"WITH {WIDE_SQL}, d AS (" + " UNION ALL ".join(
        f"SELECT '{x}' AS model_a, '{y}' AS model_b, abs(y_true - {cols[x]}) - abs(y_true - {cols[y]}) AS d FROM wide" for x, y in pairs
    ) + f"""), s AS (SELECT model_a, model_b, count(*) AS n, avg(d) AS m, var_pop(d) AS v FROM d GROUP BY 1, 2)
SELECT model_a, model_b, n, {R('m')} AS mean_diff, {R('v')} AS var_diff, {R('m / sqrt(v / n) * sqrt((n - 1) / n)')} AS dm FROM s"""


@query("a22_dm_statistics", dm_sql())
def dm_statistics(spark, sf):
    return evaluate.dm_matrix(predictions(spark, sf), MODELS)


# Two-sided tail of Student's t: Hill's normalising transform of 1970, whose error is far below six decimals at hundreds of degrees of freedom,
# and the normal integral as a series. Beyond 7 deviations the tail is zero to eleven decimals.
P_VALUE_SQL = f"""WITH d AS ({dm_sql()}),
h AS (SELECT *, n - 1.5 AS a, 48 * (n - 1.5) * (n - 1.5) AS b, sqrt((n - 1.5) * ln(1 + dm * dm / (n - 1))) AS y FROM d),
z AS (SELECT *, y + (power(y, 3) + 3 * y) / b - (4 * power(y, 7) + 33 * power(y, 5) + 240 * power(y, 3) + 855 * y) / (10 * b * (b + 0.8 * power(y, 4) + 100)) AS z FROM h),
i AS (SELECT *, list_reduce(list_prepend([z, z], list_transform(range(1, 200), lambda k: [k::DOUBLE, 0.0])),
  lambda s, k: [s[1] * z * z / (2 * k[1] + 1), s[2] + s[1] * z * z / (2 * k[1] + 1)])[2] AS series FROM z)
SELECT model_a, model_b, n, mean_diff, var_diff, dm,
  {R('CASE WHEN var_diff <= 0 THEN 1 WHEN z > 7 THEN 0 ELSE 1 - 2 * series * exp(-z * z / 2) / sqrt(2 * pi()) END')} AS p_value FROM i"""


@query("a22_dm_p_values", P_VALUE_SQL)
def dm_p_values(spark, sf):
    return evaluate.dm_p_values(evaluate.dm_matrix(predictions(spark, sf), MODELS))


@query("a28_first_week", f"""WITH {PREDICTIONS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id, fold, model ORDER BY ts) AS rn FROM preds)
SELECT series_id, fold, model, count(*) AS valid_rows, {R('avg(abs(y_true - y_pred))')} AS "MAE",
  {R('sqrt(avg((y_true - y_pred) * (y_true - y_pred)))')} AS "RMSE" FROM r WHERE rn <= 168 GROUP BY 1, 2, 3""")
def first_week(spark, sf):
    return evaluate.residual_summary(predictions(spark, sf), HOURLY_PANEL, first_rows=168)


@query("a12_residual_histogram", f"""WITH {PREDICTIONS_SQL}, v AS (SELECT model, y_true - y_pred AS v FROM preds),
edges AS (SELECT model, min(v) AS lo, max(v) AS hi FROM v GROUP BY 1),
placed AS (SELECT model, lo, (hi - lo) / 40 AS w, least(floor((v - lo) / ((hi - lo) / 40)) + 1, 40) AS bin FROM v JOIN edges USING (model))
SELECT model, CAST(bin AS BIGINT) AS bin, {R('lo + (bin - 1) * w')} AS lower, {R('lo + (bin - 1) * w + w')} AS upper, count(*) AS n
FROM placed GROUP BY model, bin, lo, w""")
def residual_histogram(spark, sf):
    from chronopanel.operators.profile import histogram
    from chronopanel.panel import Panel

    return histogram(predictions(spark, sf), Panel(("model",)), F.col("y_true") - F.col("y_pred"), 40)


@query("a29_single_fold", f"""WITH {SCORES_SQL} SELECT series_id, model, fold, {R('mae')} AS "MAE", {R('rmse')} AS "RMSE", {R('mase')} AS "MASE"
FROM scores WHERE fold = 4""")
def single_fold(spark, sf):
    return evaluate.fold_leaderboard(fold_scores(spark, sf), 4).select("series_id", "model", "fold", "MAE", "RMSE", "MASE")


@query("o3_first_rows", f"""WITH {PREDICTIONS_SQL} SELECT series_id, fold, model, ts, {R('y_true')} AS y_true, {R('y_pred')} AS y_pred FROM preds
QUALIFY row_number() OVER (PARTITION BY series_id, fold, model ORDER BY ts) <= 168""")
def first_rows(spark, sf):
    from chronopanel.panel import Panel

    return evaluate.first_n(predictions(spark, sf), Panel(("series_id", "fold", "model"), unit_rows=16), 168)


@query("o4_rank", f"""WITH {SCORES_SQL} SELECT series_id, fold, model, {R('mae')} AS "MAE",
  rank() OVER (PARTITION BY series_id, fold ORDER BY mae) AS place FROM raw_scores""")
def rank(spark, sf):
    from pyspark.sql import Window

    scores = evaluate.score(predictions(spark, sf), ["series_id", "fold", "model"])
    w = Window.partitionBy("series_id", "fold").orderBy("MAE")
    return scores.select("series_id", "fold", "model", "MAE", F.rank().over(w).alias("place"))


@query("u1_union_by_name", f"""WITH {SCORES_SQL} SELECT series_id, fold, model, {R('mae')} AS "MAE", CAST(NULL AS DOUBLE) AS fit_seconds FROM raw_scores
UNION ALL SELECT series_id, fold, model || '_copy', {R('mae')}, {R('1.5')} FROM raw_scores""")
def union_by_name(spark, sf):
    base = evaluate.score(predictions(spark, sf), ["series_id", "fold", "model"]).select("series_id", "fold", "model", "MAE")
    timed = base.withColumn("model", F.concat("model", F.lit("_copy"))).withColumn("fit_seconds", F.lit(1.5))
    return base.unionByName(timed, allowMissingColumns=True)


@query("u2_distinct_rows", f"WITH {PREDICTIONS_SQL} SELECT DISTINCT series_id, fold, ts, {R('y_true')} AS y_true FROM preds")
def distinct_rows(spark, sf):
    return predictions(spark, sf).select("series_id", "fold", "ts", "y_true").dropDuplicates()


STACK_SQL = WIDE_SQL + """,
tr AS (SELECT *, avg(a) OVER () AS ma, avg(b) OVER () AS mb, avg(y_true) OVER () AS my FROM wide WHERE fold < 4),
g AS (SELECT any_value(ma) AS ma, any_value(mb) AS mb, any_value(my) AS my, sum((a - ma) * (a - ma)) + 1 AS saa, sum((b - mb) * (b - mb)) + 1 AS sbb,
  sum((a - ma) * (b - mb)) AS sab, sum((a - ma) * (y_true - my)) AS say, sum((b - mb) * (y_true - my)) AS sby FROM tr),
w AS (SELECT *, (say * sbb - sby * sab) / (saa * sbb - sab * sab) AS wa, (sby * saa - say * sab) / (saa * sbb - sab * sab) AS wb FROM g),
k AS (SELECT wa, wb, my - wa * ma - wb * mb AS w0 FROM w)"""


@query("m8_stacking", f"""WITH {STACK_SQL} SELECT series_id, fold, ts, 'stacking_ridge' AS model, {R('y_true')} AS y_true,
  {R('greatest(w0 + wa * a + wb * b, 0)')} AS y_pred FROM wide, k WHERE fold = 4""")
def stacking(spark, sf):
    return ensemble.stack(predictions(spark, sf), MODELS[:2], holdout=HOURLY_FOLDS["n_folds"])[0]


@query("m8_stack_mase", f"""WITH {STACK_SQL}, d AS (SELECT series_id, abs(y_true - lag(y_true, 24) OVER (PARTITION BY series_id ORDER BY ts)) AS d FROM wide WHERE fold < 4),
sc AS (SELECT series_id, avg(d) AS scale FROM d GROUP BY 1),
p AS (SELECT series_id, fold, y_true, greatest(w0 + wa * a + wb * b, 0) AS p FROM wide, k WHERE fold = 4)
SELECT series_id, fold, {R('avg(abs(y_true - p))')} AS "MAE", {R('avg(abs(y_true - p)) / any_value(scale)')} AS "MASE" FROM p JOIN sc USING (series_id) GROUP BY 1, 2""")
def stack_mase(spark, sf):
    """The stack's errors against the seasonal differences of the folds that it learned from."""
    preds = materialize(predictions(spark, sf))
    out, _ = ensemble.stack(preds, MODELS[:2], holdout=HOURLY_FOLDS["n_folds"])
    scale = evaluate.stack_scale(preds.filter(F.col("model").isin(MODELS[:2])), HOURLY_PANEL, HOURLY_FOLDS["n_folds"])
    scores = evaluate.score(out, ["series_id", "fold"], scale=scale, scale_on=["series_id", "fold"])
    return scores.select("series_id", "fold", "MAE", "MASE")


@query("m8_stacking_weights", f"""WITH {STACK_SQL} SELECT 'naive_lag_1h' AS base_model, {R('wa')} AS coefficient FROM k
UNION ALL SELECT 'naive_lag_24h_daily', {R('wb')} FROM k UNION ALL SELECT 'intercept', {R('w0')} FROM k""")
def stacking_weights(spark, sf):
    return ensemble.stack(predictions(spark, sf), MODELS[:2], holdout=HOURLY_FOLDS["n_folds"])[1].coefficients(spark)
