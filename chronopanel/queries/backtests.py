"""Fold plans, forecasters, backtests and scores."""

import numpy as np
from pyspark.sql import functions as F

from chronopanel.functions.metrics import metric
from chronopanel.operators import evaluate, features, forecast
from chronopanel.operators.resample import resample
from chronopanel.plans.folds import assign_folds, fold_plan, fold_status, fold_table
from chronopanel.queries.base import (
    DAILY_PANEL, DAILY_SQL, HOURLY_FOLDS, HOURLY_PANEL, HOURLY_SQL, LAGGED_SQL, PREDICTIONS_SQL, R, SCALE_SQL, SCORES_SQL,
    by_user, daily, folds_sql, hourly, query, table,
)
from chronopanel.queries.tables import lag_matrix, predictions, stored_plan
from chronopanel.session import materialize, new_folder

MODELS = ["naive_lag_1h", "naive_lag_24h_daily", "naive_lag_168h_weekly"]


def unscored_sql(columns: str, models: list[str], scores: str) -> str:
    """A row for each series of the events and each model that has no scores; ``columns`` says what is in it."""
    names = ", ".join(f"('{m}')" for m in models)
    same = " AND x.model = m.model" if len(models) > 1 else ""
    return (f" UNION ALL SELECT {columns} FROM (SELECT DISTINCT event_type AS series_id FROM events) s, (VALUES {names}) m(model)"
            f" WHERE NOT EXISTS (SELECT 1 FROM {scores} x WHERE x.series_id = s.series_id{same})")


NO_BOARD = "s.series_id, m.model, 0, 0, " + ", ".join(["NULL"] * 2 * len(evaluate.LEADERBOARD_METRICS))
FLAGSHIP_FOLDS = {"n_folds": 6, "train_days": 10, "valid_days": 3, "gap_days": 0}


@query("flagship_leaderboard", f"""WITH {HOURLY_SQL},
lagged AS (SELECT series_id, ts, value, lag(value, 1) OVER (PARTITION BY series_id ORDER BY ts) AS l1 FROM hourly),
matrix AS (SELECT * FROM lagged WHERE l1 IS NOT NULL),
{folds_sql('matrix', 6, 10, 3)},
preds AS (SELECT m.series_id, f.fold, m.value AS y, m.l1 AS p FROM matrix m JOIN folds f
          ON m.series_id = f.series_id AND m.ts BETWEEN f.valid_start AND f.valid_end),
{SCALE_SQL},
sc AS (SELECT series_id, fold, count(*) AS n, avg(abs(y - p)) AS "MAE", sqrt(avg((y - p) * (y - p))) AS "RMSE",
  sum(abs(y - p)) / sum(abs(y)) AS "WAPE",
  avg(CASE WHEN abs(y) + abs(p) = 0 THEN 0 ELSE abs(y - p) / ((abs(y) + abs(p)) / 2) END) AS "sMAPE" FROM preds GROUP BY 1, 2),
full_sc AS (SELECT sc.*, "MAE" / scale AS "MASE" FROM sc JOIN scales USING (series_id, fold))
SELECT series_id, 'naive_lag_1h' AS model, count(*) AS n_folds, count(*) FILTER (WHERE "MAE" IS NULL OR "RMSE" IS NULL OR "WAPE" IS NULL
  OR "sMAPE" IS NULL OR "MASE" IS NULL) AS n_undefined, """ + ", ".join(
    f'{R(f"""avg("{m}")""", 5)} AS "{m}_mean", {R(f"""stddev_samp("{m}")""", 5)} AS "{m}_std"' for m in evaluate.LEADERBOARD_METRICS
) + " FROM full_sc GROUP BY 1" + unscored_sql(NO_BOARD, MODELS[:1], "full_sc"))
def flagship(spark, sf):
    """Hourly mean, lag 1, rolling-origin folds, naive forecast, metrics, leaderboard per series."""
    matrix = materialize(features.build_features(
        hourly(spark, sf), HOURLY_PANEL, "value", (1,), (), calendar=False, cyclical=False, holidays=False
    ))
    folds = fold_plan(matrix, HOURLY_PANEL, **FLAGSHIP_FOLDS, strict=False).persist()
    preds = forecast.naive_predictions(matrix, HOURLY_PANEL, "value", folds, [forecast.NaiveLag("value_lag_1h", "naive_lag_1h")])
    scale = evaluate.mase_scale(matrix, HOURLY_PANEL, "value", folds)
    scores = evaluate.score(preds, ["series_id", "fold", "model"], scale=scale, scale_on=["series_id", "fold"])
    board = evaluate.leaderboard(scores, ["series_id"], decimals=5)
    status = fold_status(matrix, HOURLY_PANEL, **FLAGSHIP_FOLDS, series=table(spark, sf, "events").select(F.col("event_type").alias("series_id")))
    return evaluate.with_unscored(board, status, ["series_id"], ["naive_lag_1h"]).drop("reason")


@query("m1_fold_plan", f"WITH {LAGGED_SQL}, {folds_sql('matrix', 4, 8, 3)} SELECT * FROM folds")
def rolling_origin(spark, sf):
    return stored_plan(spark, sf)[1]


@query("m1_fold_plan_daily", f"WITH {DAILY_SQL}, {folds_sql('daily', 6, 365, 30, 2, '1 day')} SELECT * FROM folds")
def rolling_origin_daily(spark, sf):
    return fold_plan(daily(spark, sf), DAILY_PANEL, gap_days=2)


FOLD_COUNTS_SQL = """counts AS (SELECT f.series_id, f.fold, count(*) FILTER (WHERE m.ts BETWEEN f.train_start AND f.train_end) AS train_rows,
  count(*) FILTER (WHERE m.ts BETWEEN f.valid_start AND f.valid_end) AS valid_rows FROM folds f JOIN matrix m USING (series_id) GROUP BY 1, 2)"""


@query("m2_fold_table", f"""WITH {LAGGED_SQL}, {folds_sql('matrix', 4, 8, 3)}, {FOLD_COUNTS_SQL}
SELECT series_id, fold, train_start, train_end, valid_start, valid_end,
  {R('round((epoch(train_end) - epoch(train_start)) / 86400, 1)')} AS train_days,
  {R('round((epoch(valid_end) - epoch(valid_start)) / 86400, 1)')} AS valid_days, train_rows, valid_rows,
  {R('round(valid_rows / 72, 3)')} AS valid_completeness, 72 - valid_rows AS missing_valid_rows
FROM folds JOIN counts USING (series_id, fold)""")
def fold_overview(spark, sf):
    matrix, folds = stored_plan(spark, sf)
    return fold_table(matrix, HOURLY_PANEL, folds)


@query("a25_split_completeness", f"""WITH {LAGGED_SQL}, {folds_sql('matrix', 4, 8, 3)}, {FOLD_COUNTS_SQL}
SELECT series_id, fold, valid_rows, {R('round(valid_rows / 72, 3)')} AS valid_completeness, 72 - valid_rows AS missing_valid_rows FROM counts""")
def split_completeness(spark, sf):
    matrix, folds = stored_plan(spark, sf)
    return fold_table(matrix, HOURLY_PANEL, folds).select("series_id", "fold", "valid_rows", "valid_completeness", "missing_valid_rows")


@query("j6_fold_assignment", f"""WITH {LAGGED_SQL}, {folds_sql('matrix', 4, 8, 3)}
SELECT m.series_id, m.ts, {R('m.value')} AS value, f.fold, CASE WHEN m.ts >= f.valid_start THEN 'valid' ELSE 'train' END AS role
FROM matrix m JOIN folds f ON m.series_id = f.series_id AND m.ts BETWEEN f.train_start AND f.valid_end""")
def fold_assignment(spark, sf):
    matrix, folds = stored_plan(spark, sf)
    return assign_folds(matrix.select("series_id", "ts", "value"), HOURLY_PANEL, folds).drop("fold_from")


@query("m3_naive_forecasts", f"""WITH {PREDICTIONS_SQL} SELECT series_id, model, fold, ts, {R('y_true')} AS y_true, {R('y_pred')} AS y_pred FROM preds""")
def naive_forecasts(spark, sf):
    return predictions(spark, sf)


SCORE_COLUMNS = f"""series_id, fold, model, valid_rows, {R('mae')} AS "MAE", {R('rmse')} AS "RMSE", {R('wape')} AS "WAPE", {R('smape')} AS "sMAPE" """


@query("a16_point_metrics", f"WITH {PREDICTIONS_SQL}, {SCALE_SQL}, " + SCORES_SQL[len(PREDICTIONS_SQL) + len(SCALE_SQL) + 4:] + f" SELECT {SCORE_COLUMNS} FROM raw_scores")
def point_metrics(spark, sf):
    return evaluate.score(predictions(spark, sf), ["series_id", "fold", "model"]).drop(*evaluate.CHECKS)


@query("a17_mase", f"""WITH {SCORES_SQL} SELECT {SCORE_COLUMNS}, {R('mase')} AS "MASE" FROM scores""")
def mase(spark, sf):
    return fold_scores(spark, sf).drop(*evaluate.CHECKS)


def fold_scores(spark, sf):
    matrix, folds = stored_plan(spark, sf)
    preds = forecast.naive_predictions(matrix, HOURLY_PANEL, "value", folds, forecast.naive_baselines("value"))
    scale = evaluate.mase_scale(matrix, HOURLY_PANEL, "value", folds)
    return evaluate.score(preds, ["series_id", "fold", "model"], scale=scale, scale_on=["series_id", "fold"])


@query("a18_mape", f"""WITH {PREDICTIONS_SQL} SELECT series_id, fold, model,
  {R('avg(abs(y_true - y_pred) / greatest(abs(y_true), 1e-6)) * 100')} AS "MAPE" FROM preds GROUP BY 1, 2, 3""")
def mape(spark, sf):
    return predictions(spark, sf).groupBy("series_id", "fold", "model").agg(metric("MAPE")("y_true", "y_pred").alias("MAPE"))


@query("x2_metrics_by_name", f"""WITH {PREDICTIONS_SQL} SELECT model, {R('avg(abs(y_true - y_pred))')} AS "MAE",
  {R('sum(abs(y_true - y_pred)) / sum(abs(y_true))')} AS "WAPE" FROM preds GROUP BY 1""")
def metrics_by_name(spark, sf):
    names = ["MAE", "WAPE"]
    return predictions(spark, sf).groupBy("model").agg(*[metric(n)("y_true", "y_pred").alias(n) for n in names])


BOARD_SQL = ", ".join(
    f'{R(f"avg({m.lower()})", 5)} AS "{m}_mean", {R(f"stddev_samp({m.lower()})", 5)} AS "{m}_std"' for m in evaluate.LEADERBOARD_METRICS
)


@query("a19_leaderboard", f"WITH {SCORES_SQL} SELECT series_id, model, count(*) AS n_folds, "
       f"count(*) FILTER (WHERE mae IS NULL OR rmse IS NULL OR wape IS NULL OR smape IS NULL OR mase IS NULL) AS n_undefined, {BOARD_SQL} FROM scores GROUP BY 1, 2"
       + unscored_sql(NO_BOARD, MODELS, "scores"))
def leaderboard(spark, sf):
    board = evaluate.leaderboard(fold_scores(spark, sf), ["series_id"], decimals=5)
    return evaluate.with_unscored(board, plan_status(spark, sf), ["series_id"], MODELS).drop("reason")


def plan_status(spark, sf):
    """`fold_status` of the stored plan, over all series of the events."""
    series = table(spark, sf, "events").select(F.col("event_type").alias("series_id"))
    return fold_status(lag_matrix(spark, sf), HOURLY_PANEL, **HOURLY_FOLDS, series=series)


# Per user few series span the plan. Every user comes out, whatever the plan says, written from the spans of all users.
USER_FOLDS = {"n_folds": 4, "train_days": 20, "valid_days": 2, "gap_days": 1}
USER_SCORES_SQL = f"""u AS (SELECT user_id AS series_id, date_trunc('hour', ts) AS ts, avg(value) AS value FROM events GROUP BY 1, 2),
lagged AS (SELECT series_id, ts, value, lag(value, 1) OVER (PARTITION BY series_id ORDER BY ts) AS l1 FROM u),
matrix AS (SELECT * FROM lagged WHERE l1 IS NOT NULL),
{folds_sql('matrix', 4, 20, 2, 1)},
preds AS (SELECT m.series_id, f.fold, m.value AS y, m.l1 AS p FROM matrix m JOIN folds f
          ON m.series_id = f.series_id AND m.ts BETWEEN f.valid_start AND f.valid_end),
sc AS (SELECT series_id, fold, count(*) AS n, avg(abs(y - p)) AS mae FROM preds GROUP BY 1, 2),
status AS (SELECT s.series_id, coalesce(epoch(max(m.ts)) - epoch(min(m.ts)), 0) >= 29 * 86400 AS enough
           FROM (SELECT DISTINCT user_id AS series_id FROM events) s LEFT JOIN matrix m USING (series_id) GROUP BY 1),
reasons AS (SELECT series_id, CASE WHEN enough THEN 'no rows to score' ELSE 'series too short' END AS why FROM status)"""


def user_scores(spark, sf):
    users = by_user(spark, sf)
    matrix = materialize(features.build_features(users, HOURLY_PANEL, "value", (1,), (), calendar=False, cyclical=False, holidays=False))
    folds = fold_plan(matrix, HOURLY_PANEL, **USER_FOLDS, strict=False).persist()
    preds = forecast.naive_predictions(matrix, HOURLY_PANEL, "value", folds, [forecast.NaiveLag("value_lag_1h", "naive_lag_1h")])
    scores = evaluate.score(preds, ["series_id", "fold", "model"], {"MAE": metric("MAE")})
    series = table(spark, sf, "events").select(F.col("user_id").alias("series_id"))
    return scores, fold_status(matrix, HOURLY_PANEL, **USER_FOLDS, series=series)


@query("a19_leaderboard_short_series", f"""WITH {USER_SCORES_SQL}
SELECT series_id, 'naive_lag_1h' AS model, count(sc.fold) AS n_folds, count(*) FILTER (WHERE sc.fold IS NOT NULL AND mae IS NULL) AS n_undefined,
  {R('avg(mae)')} AS "MAE_mean", {R('stddev_samp(mae)')} AS "MAE_std", CASE WHEN count(sc.fold) = 0 THEN min(why) END AS reason
FROM reasons LEFT JOIN sc USING (series_id) GROUP BY 1""")
def leaderboard_short_series(spark, sf):
    scores, status = user_scores(spark, sf)
    return evaluate.with_unscored(evaluate.leaderboard(scores, ["series_id"], ["MAE"], decimals=9), status, ["series_id"], ["naive_lag_1h"])


@query("m9_fold_results_short_series", f"""WITH {USER_SCORES_SQL}
SELECT series_id, sc.fold, 'naive_lag_1h' AS model, coalesce(n, 0) AS valid_rows, {R('mae')} AS "MAE", CASE WHEN sc.fold IS NULL THEN why END AS reason
FROM reasons LEFT JOIN sc USING (series_id)""")
def fold_results_short_series(spark, sf):
    scores, status = user_scores(spark, sf)
    return evaluate.with_unscored(scores.drop(*evaluate.CHECKS), status, ["series_id"], ["naive_lag_1h"])


@query("m9_backtest_naive", f"""WITH {PREDICTIONS_SQL} SELECT series_id, model, fold, ts, {R('y_true')} AS y_true, {R('y_pred')} AS y_pred FROM preds""")
def backtest_naive(spark, sf):
    matrix, folds = stored_plan(spark, sf)
    return forecast.backtest(matrix, HOURLY_PANEL, "value", folds, forecast.naive_baselines("value")).predictions


@query("m9_resumed_backtest", f"""WITH {PREDICTIONS_SQL} SELECT series_id, model, fold, ts, {R('y_true')} AS y_true, {R('y_pred')} AS y_pred FROM preds""")
def resumed_backtest(spark, sf):
    """A run that stops after two folds, and another that takes it up: the rows of a straight run."""
    matrix, folds = stored_plan(spark, sf)
    folder, models = new_folder(spark, "run"), forecast.naive_baselines("value")
    assert forecast.resumable_backtest(matrix, HOURLY_PANEL, "value", folds, models, folder, max_fits=2) is None
    return forecast.resumable_backtest(matrix, HOURLY_PANEL, "value", folds, models, folder).predictions.select("series_id", "model", "fold", "ts", "y_true", "y_pred")


def tree_inputs(spark, sf):
    """The matrix with the default lags and windows, and six folds: with a lag of 168 rows the month of events spans some 22 days."""
    matrix = materialize(features.build_features(hourly(spark, sf), HOURLY_PANEL, "value"))
    return matrix, fold_plan(matrix, HOURLY_PANEL, 6, 9, 2, strict=False).persist()


@query("m4_boosted_trees")
def boosted_trees(spark, sf):
    """500 trees of depth 6 on each of six folds. README has its time."""
    matrix, folds = tree_inputs(spark, sf)
    run = forecast.backtest(matrix, HOURLY_PANEL, "value", folds, [forecast.BoostedTrees()])
    return evaluate.score(run.predictions, ["model", "fold"]).drop(*evaluate.CHECKS)


@query("m6_random_forest")
def random_forest(spark, sf):
    """250 trees of depth 16 on each of six folds. README has its time."""
    matrix, folds = tree_inputs(spark, sf)
    run = forecast.backtest(matrix, HOURLY_PANEL, "value", folds, [forecast.Forest()])
    return run.predictions


CUT_FEATURES = ("hour", "day_of_week", "day_of_month", "level")


def one_cut_sql(least: int) -> str:
    """Per fold, the cut of all training rows that takes most off the squared error, each side with ``least`` rows or more."""
    long = " UNION ALL ".join(f"SELECT fold, {i} AS i, '{f}' AS feature, {f} AS x, value AS y FROM train" for i, f in enumerate(CUT_FEATURES))
    return f"""WITH {LAGGED_SQL},
{folds_sql('matrix', 4, 8, 3)},
train AS (SELECT f.fold, m.value, hour(m.ts) AS hour, (dayofweek(m.ts) + 6) % 7 AS day_of_week, day(m.ts) AS day_of_month, floor(m.l1 / 5) AS level
  FROM matrix m JOIN folds f ON m.series_id = f.series_id AND m.ts BETWEEN f.train_start AND f.train_end),
long AS ({long}),
per AS (SELECT fold, i, feature, x, count(*) AS k, sum(y) AS t FROM long GROUP BY 1, 2, 3, 4),
sums AS (SELECT fold, i, feature, x, sum(k) OVER w AS n_left, sum(t) OVER w AS s_left FROM per WINDOW w AS (PARTITION BY fold, i ORDER BY x)),
whole AS (SELECT fold, count(*) AS n, sum(value) AS s FROM train GROUP BY 1),
gains AS (SELECT fold, i, feature, x, s_left / n_left AS low, (s - s_left) / (n - n_left) AS high,
  s_left * s_left / n_left + (s - s_left) * (s - s_left) / (n - n_left) - s * s / n AS gain
  FROM sums JOIN whole USING (fold) WHERE n_left >= {least} AND n - n_left >= {least})
SELECT fold, feature, {R('x')} AS threshold, {R('low')} AS mean_left, {R('high')} AS mean_right
FROM gains QUALIFY row_number() OVER (PARTITION BY fold ORDER BY gain DESC, i, x) = 1"""


def one_cut(spark, sf, model):
    """The first tree of a model of depth 1, as a table."""
    matrix, folds = stored_plan(spark, sf)
    ts = F.col("ts")
    rows = matrix.select("series_id", "ts", "value", F.hour(ts).alias("hour"), F.weekday(ts).alias("day_of_week"), F.dayofmonth(ts).alias("day_of_month"),
                         F.floor(F.col("value_lag_1h") / 5).alias("level"))
    fit = model.fit_folds(assign_folds(rows, HOURLY_PANEL, folds, roles=("train",)), "value", CUT_FEATURES).ensemble
    nodes = fit.thresholds()
    mean = F.element_at(F.create_map(*[F.lit(v) for kv in fit.means.items() for v in kv]), F.col("fold")) if fit.how.boosted else F.lit(0.0)
    side = nodes.select("fold", "node", (mean + F.col("value")).alias("at"))
    at = lambda shift, name: side.select("fold", (F.col("node") - shift).alias("left"), F.col("at").alias(name))
    return nodes.filter("left >= 0").join(at(0, "mean_left"), ["fold", "left"]).join(at(1, "mean_right"), ["fold", "left"]).select(
        "fold", F.col("name").alias("feature"), "threshold", "mean_left", "mean_right")


@query("m4_one_tree", one_cut_sql(1))
def boosted_one_tree(spark, sf):
    """What m4 does, where SQL can say it: one tree with one cut, all rows, no penalty."""
    return one_cut(spark, sf, forecast.BoostedTrees(trees=1, depth=1, step=1.0, row_share=1.0, column_share=1.0, l2=0.0))


@query("m6_one_tree", one_cut_sql(300))
def forest_one_tree(spark, sf):
    """What m6 does, where SQL can say it: one tree with one cut, without a draw, 300 rows to a leaf."""
    return one_cut(spark, sf, forecast.Forest(trees=1, depth=1, min_leaf=300, bootstrap=False))


@query("m6_forecast_rows", f"""WITH {LAGGED_SQL}, full_matrix AS (SELECT series_id, ts, value FROM matrix),
{folds_sql('full_matrix', 6, 9, 2)}
SELECT m.series_id, f.fold, m.ts, {R('m.value')} AS y_true, true AS forecast FROM full_matrix m JOIN folds f
ON m.series_id = f.series_id AND m.ts BETWEEN f.valid_start AND f.valid_end""")
def forest_rows(spark, sf):
    """The rows that m6 forecasts, each with a forecast; of a small forest, as all have the same rows."""
    matrix, folds = tree_inputs(spark, sf)
    run = forecast.backtest(matrix, HOURLY_PANEL, "value", folds, [forecast.Forest(trees=4, depth=3)])
    return run.predictions.select("series_id", "fold", "ts", "y_true", F.col("y_pred").isNotNull().alias("forecast"))


def daily_exogenous(spark, sf):
    """Daily order totals as outside columns: mean price and a one-day lag of it."""
    orders = table(spark, sf, "orders").groupBy(F.col("o_orderdate").alias("ts")).agg(
        F.avg("o_totalprice").alias("external_order_price"), F.count(F.lit(1)).cast("double").alias("external_orders")
    )
    return orders


@query("j1_exogenous_join", f"""WITH {DAILY_SQL}, o AS (SELECT o_orderdate AS ts, avg(o_totalprice) AS p, count(*) AS n FROM orders GROUP BY 1)
SELECT series_id, ts, {R('quantity')} AS quantity, {R('p')} AS external_order_price, {R('n')} AS external_orders FROM daily JOIN o USING (ts)""")
def exogenous_join(spark, sf):
    from chronopanel.plans.units import small_join

    return small_join(daily(spark, sf).drop("value"), daily_exogenous(spark, sf), ["ts"])


@query("m5_trees_with_exogenous")
def trees_with_exogenous(spark, sf):
    """500 trees of depth 6 on each of six folds of 365 and 30 days. README has its time."""
    from chronopanel.operators.registry import default_registry
    from chronopanel.plans.units import small_join

    registry = default_registry("quantity").register("external_*", "external", True, "known outside the series")
    joined = small_join(daily(spark, sf).drop("value"), daily_exogenous(spark, sf), ["ts"])
    matrix = materialize(features.build_features(joined, DAILY_PANEL, "quantity", (1, 7), (3, 7), registry=registry, outside_lags={"external_order_price": (1,)}))
    folds = fold_plan(matrix, DAILY_PANEL)
    run = forecast.backtest(matrix, DAILY_PANEL, "quantity", folds, [forecast.BoostedTrees(name="trees_exogenous")])
    return evaluate.score(run.predictions, ["model", "fold"]).drop(*evaluate.CHECKS)


@query("a23_feature_importance")
def feature_importance(spark, sf):
    """Of 500 trees of depth 6 on each of six folds. README has its time."""
    matrix, folds = tree_inputs(spark, sf)
    run = forecast.backtest(matrix, HOURLY_PANEL, "value", folds, [forecast.BoostedTrees()])
    return evaluate.mean_importance(run.importances)


@query("x1_per_series_model", f"""WITH {PREDICTIONS_SQL},
means AS (SELECT m.series_id, f.fold, hour(m.ts) AS h, avg(m.value) AS y FROM matrix m JOIN folds f
  ON m.series_id = f.series_id AND m.ts BETWEEN f.train_start AND f.train_end GROUP BY 1, 2, 3)
SELECT v.series_id, 'hour_mean' AS model, v.fold, v.ts, {R('v.value')} AS y_true, {R('m.y')} AS y_pred
FROM valid v LEFT JOIN means m ON v.series_id = m.series_id AND v.fold = m.fold AND hour(v.ts) = m.h""")
def per_series_model(spark, sf):
    """A user's own model: the training mean at the same hour of day."""
    def hour_mean(train, valid):
        means = train.groupby(train["ts"].dt.hour)["value"].mean()
        return valid["ts"].dt.hour.map(means).to_numpy(dtype=np.float64)

    matrix, folds = stored_plan(spark, sf)
    return forecast.backtest(matrix, HOURLY_PANEL, "value", folds, [forecast.PerSeries(hour_mean, "hour_mean")]).predictions


@query("m10_seasonal_naive_path", f"""WITH {HOURLY_SQL}, o AS (SELECT series_id, max(ts) - INTERVAL 72 HOUR AS origin FROM hourly GROUP BY 1),
s AS (SELECT series_id, origin, h FROM o, (SELECT unnest(generate_series(1, 48)) AS h))
SELECT s.series_id, s.origin, s.h, s.origin + to_hours(CAST(s.h AS INTEGER)) AS ts, {R('p.value')} AS y_pred FROM s LEFT JOIN hourly p
  ON p.series_id = s.series_id AND p.ts = s.origin + to_hours(CAST(s.h - CAST(ceil(s.h / 24) AS BIGINT) * 24 AS INTEGER))""")
def seasonal_naive_path(spark, sf):
    return path_with_reasons(spark, sf).drop("reason")


def path_with_reasons(spark, sf):
    h = hourly(spark, sf)
    origins = h.groupBy("series_id").agg((F.max("ts") - F.expr("interval 72 hours")).alias("origin"))
    return forecast.seasonal_naive_path(h, HOURLY_PANEL, "value", origins, 48, 24)


# Written from the rule: every series has exactly 48 steps; a step without an observation a season back says so.
@query("m10_path_complete", f"""WITH {HOURLY_SQL}, o AS (SELECT series_id, max(ts) - INTERVAL 72 HOUR AS origin FROM hourly GROUP BY 1),
s AS (SELECT series_id, origin, h, origin + to_hours(CAST(h AS INTEGER)) AS at, CASE WHEN h <= 24 THEN h ELSE h - 24 END AS k
      FROM o, (SELECT unnest(generate_series(1, 48)) AS h)),
known AS (SELECT s.*, (SELECT avg(e.value) FROM events e WHERE e.event_type = s.series_id
          AND date_trunc('hour', e.ts) = s.origin - INTERVAL 24 HOUR + to_hours(CAST(s.k AS INTEGER))) AS v FROM s)
SELECT series_id, count(*) AS steps, count(v) AS known_steps, sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END)::BIGINT AS reasons,
       {R('sum(v)')} AS total FROM known GROUP BY 1""")
def path_complete(spark, sf):
    return path_with_reasons(spark, sf).groupBy("series_id").agg(
        F.count(F.lit(1)).alias("steps"), F.count("y_pred").alias("known_steps"), F.count("reason").alias("reasons"), F.sum("y_pred").alias("total"))


# A forecast is lost where the hour is a multiple of 5 and is NaN where it is one more.
@query("a16_missing_predictions", f"""WITH {PREDICTIONS_SQL},
p AS (SELECT series_id, fold, model, y_true AS y, CASE WHEN hour(ts) % 5 > 1 THEN y_pred END AS q FROM preds)
SELECT series_id, fold, model, count(*) AS valid_rows, count(q) AS paired_rows, count(*) - count(q) AS missing_predictions,
  {R('avg(abs(y - q))')} AS "MAE", {R('sqrt(avg((y - q) ** 2))')} AS "RMSE",
  {R('sum(abs(y - q)) / sum(CASE WHEN q IS NOT NULL THEN abs(y) END)')} AS "WAPE",
  {R('avg(CASE WHEN abs(y) + abs(q) = 0 THEN 0 ELSE 2 * abs(y - q) / (abs(y) + abs(q)) END)')} AS "sMAPE",
  CASE WHEN count(q) < count(*) THEN 'missing_predictions' ELSE '' END AS undefined FROM p GROUP BY 1, 2, 3""")
def missing_predictions(spark, sf):
    part = F.hour("ts") % 5
    holes = F.when(part == 1, F.lit(float("nan"))).when(part > 1, F.col("y_pred"))
    return evaluate.score(predictions(spark, sf).withColumn("y_pred", holes), ["series_id", "fold", "model"])


# Per user, few series span the plan; none may vanish.
@query("m1_short_series", f"""WITH u AS (SELECT DISTINCT user_id AS series_id, date_trunc('hour', ts) AS ts FROM events),
s AS (SELECT series_id, count(*) AS n_rows, epoch(max(ts)) - epoch(min(ts)) AS span FROM u GROUP BY 1)
SELECT series_id, n_rows, {R('span / 86400')} AS span_days, {R('29.0')} AS needed_days,
  CASE WHEN span >= 29 * 86400 THEN 4 ELSE 0 END::BIGINT AS n_folds, CASE WHEN span < 29 * 86400 THEN 'series too short' END AS reason FROM s""")
def short_series(spark, sf):
    return fold_status(by_user(spark, sf), HOURLY_PANEL, 4, 20, 2, 1)


@query("m9_fold_results", f"""WITH {SCORES_SQL} SELECT {SCORE_COLUMNS}, {R('mase')} AS "MASE", TRUE AS no_fit FROM scores"""
       + unscored_sql("s.series_id, NULL, m.model, 0, NULL, NULL, NULL, NULL, NULL, TRUE", MODELS, "scores"))
def fold_results(spark, sf):
    """One frame per run: fold, model, rows, seconds of the fit (none for lag models), five metrics."""
    matrix, folds = stored_plan(spark, sf)
    run = forecast.backtest(matrix, HOURLY_PANEL, "value", folds, forecast.naive_baselines("value"))
    scale = evaluate.mase_scale(matrix, HOURLY_PANEL, "value", folds)
    scores = evaluate.score(run.predictions, ["series_id", "fold", "model"], scale=scale, scale_on=["series_id", "fold"])
    out = evaluate.with_unscored(run.fold_results(scores), plan_status(spark, sf), ["series_id"], MODELS).drop("reason")
    return out.withColumn("no_fit", F.col("fit_seconds").isNull()).drop("fit_seconds", *evaluate.CHECKS)


@query("w1_exogenous_lag", f"""WITH {DAILY_SQL}, o AS (SELECT o_orderdate AS ts, avg(o_totalprice) AS p FROM orders GROUP BY 1),
j AS (SELECT series_id, ts, quantity, p FROM daily JOIN o USING (ts)),
l AS (SELECT *, lag(quantity, 1) OVER w AS q1, lag(p, 1) OVER w AS p1, lag(p, 7) OVER w AS p7 FROM j WINDOW w AS (PARTITION BY series_id ORDER BY ts))
SELECT series_id, ts, {R('quantity')} AS quantity, {R('p')} AS external_order_price, {R('q1')} AS quantity_lag_1h,
  {R('p1')} AS external_order_price_lag_1h, {R('p7')} AS external_order_price_lag_7h FROM l WHERE p7 IS NOT NULL AND q1 IS NOT NULL""")
def exogenous_lag(spark, sf):
    from chronopanel.operators.registry import default_registry
    from chronopanel.plans.units import small_join

    registry = default_registry("quantity").register("external_*", "external", True, "known outside the series")
    joined = small_join(daily(spark, sf).drop("value"), daily_exogenous(spark, sf).drop("external_orders"), ["ts"])
    return features.build_features(joined, DAILY_PANEL, "quantity", (1,), (), calendar=False, cyclical=False, holidays=False,
                                   registry=registry, outside_lags={"external_order_price": (1, 7)})
