"""Gap policy, gap summaries, resampling."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chronopanel import Panel, PanelError
from chronopanel.operators import impute, quality
from chronopanel.operators.resample import calendar_mean, resample
from tests.helpers import START, column, holes, same, seasonal_values, series, union

MINUTE = timedelta(minutes=1)
P = Panel(freq="1min")


def test_fill_uses_only_the_past(spark):
    out = impute.fill_gaps(series(spark, [1.0, None, 100.0, 100.0, 100.0], MINUTE), P, ["y"])
    assert column(out, "y") == [1.0, 1.0, 100.0, 100.0, 100.0]
    out = impute.fill_gaps(series(spark, [10.0, None, None, 1000.0, 1000.0, 1000.0], MINUTE), P, ["y"])
    assert column(out, "y")[1:3] == [10.0, 10.0]


def test_long_gap_is_nulled_and_flagged(spark):
    out = impute.fill_gaps(series(spark, [1.0] + [None] * 4 + [2.0], MINUTE), P, ["y"])
    assert column(out, "y") == [1.0, None, None, None, None, 2.0]
    assert column(out, "is_outage_gap") == [0, 1, 1, 1, 1, 0]
    assert column(out, "is_originally_missing") == [0, 1, 1, 1, 1, 0]


def test_short_gap_at_the_start_stays_null_without_flag(spark):
    out = impute.fill_gaps(series(spark, [None, None, 3.0], MINUTE), P, ["y"])
    assert column(out, "y") == [None, None, 3.0]
    assert column(out, "is_outage_gap") == [0, 0, 0]


def test_every_measure_of_a_long_gap_row_becomes_null(spark):
    df = series(spark, [1.0] + [None] * 4 + [2.0], MINUTE).withColumn("z", F.lit(7.0))
    out = impute.fill_gaps(df, P, ["y", "z"])
    assert column(out, "z") == [7.0, None, None, None, None, 7.0]


def test_without_remask_the_first_rows_of_a_long_gap_are_filled(spark):
    out = impute.fill_gaps(series(spark, [1.0] + [None] * 5, MINUTE), P, ["y"], remask=False)
    assert column(out, "y") == [1.0, 1.0, 1.0, 1.0, None, None]
    assert column(out, "is_outage_gap") == [0, 1, 1, 1, 1, 1]


def test_nan_counts_as_missing(spark):
    df = quality.nan_to_null(series(spark, [1.0, float("nan"), 2.0], MINUTE), ["y"])
    assert column(impute.fill_gaps(df, P, ["y"]), "y") == [1.0, 1.0, 2.0]


def test_k_must_be_positive(spark):
    with pytest.raises(PanelError):
        impute.fill_gaps(series(spark, [1.0], MINUTE), P, ["y"], k=0)


def brute_gaps(values):
    out, run = [], []
    for i, v in enumerate([*values, 0.0]):
        if v is None:
            run.append(i)
        elif run:
            out.append((run[0], run[-1], len(run)))
            run = []
    return out


@pytest.mark.parametrize("unit", [1, 2, 7, 50, 100000])
def test_gaps_and_fill_do_not_depend_on_the_unit_size(spark, unit):
    values = holes(seasonal_values(400), 0.08, seed=3)
    df = union(series(spark, values, MINUTE), series(spark, [None] * 25, MINUTE, name="b"))
    p = Panel(freq="1min", unit_rows=unit)
    at = lambda i: START + i * MINUTE
    want = {("a", at(a), at(b), n) for a, b, n in brute_gaps(values)} | {("b", at(0), at(24), 25)}
    assert {tuple(r) for r in quality.gap_summary(df, p, ["y"]).collect()} == want

    by_row = {(r.series_id, r.ts): r.gap_length for r in quality.gap_lengths(df, p, ["y"]).collect()}
    lengths = {i: n for a, b, n in brute_gaps(values) for i in range(a, b + 1)}
    assert all(by_row[("a", at(i))] == lengths.get(i, 0) for i in range(400))
    assert by_row[("b", at(3))] == 25

    w = Window.partitionBy("series_id").orderBy("ts")
    plain = df.withColumn("m", F.col("y").isNull()).withColumn("r", F.row_number().over(w))
    plain = plain.withColumn("i", F.col("r") - F.sum(F.col("m").cast("int")).over(w))
    n = F.when(F.col("m"), F.count("*").over(Window.partitionBy("series_id", "m", "i"))).otherwise(0)
    fill = F.coalesce("y", F.last("y", ignorenulls=True).over(w.rowsBetween(-3, 0)))
    plain = plain.withColumn("n", n).select(
        "series_id", "ts", F.when(F.col("n") <= 3, fill).alias("y"), F.col("m").cast("tinyint").alias("is_originally_missing"),
        (F.col("n") > 3).cast("tinyint").alias("is_outage_gap"),
    )
    same(impute.fill_gaps(df, p, ["y"]), plain)


def test_resample_rules(spark):
    df = series(spark, [1.0, 2.0, None, None], timedelta(minutes=30))
    assert column(resample(df, P, "1h", "mean", ["y"]), "y") == [1.5]
    # A sum over nulls is zero, so its bucket stays.
    assert column(resample(df, P, "1h", "sum", ["y"]), "y") == [3.0, 0.0]
    assert column(resample(df, P, "1h", "mean", ["y"], dense=True), "y") == [1.5, None]
    late = series(spark, [None, 2.0, 3.0, None], timedelta(minutes=15))
    assert column(resample(late, P, "1h", "first", ["y"]), "y") == [2.0]
    assert column(resample(late, P, "1h", "last", ["y"]), "y") == [3.0]
    assert column(resample(series(spark, [5.0, 1.0, 2.0, 9.0], timedelta(minutes=15)), P, "1h", "median", ["y"]), "y") == [3.5]
    flags = late.withColumn("is_outage_gap", (F.col("y") == 3).cast("tinyint"))
    assert column(resample(flags, P, "1h", "mean"), "is_outage_gap") == [1]
    with pytest.raises(PanelError):
        resample(df, P, "1h", "mode", ["y"])
    with pytest.raises(PanelError):
        resample(df, P, "7min", "mean", ["y"])


def test_dense_grid_spans_several_strides(spark):
    df = spark.createDataFrame(
        [("a", datetime(2024, 1, 1), 1.0), ("a", datetime(2024, 1, 3, 2), 2.0)], "series_id string, ts timestamp_ntz, y double"
    )
    out = resample(df, P, "1min", "mean", ["y"], dense=True)
    assert out.count() == 50 * 60 + 1 and out.select("ts").distinct().count() == 3001


def test_calendar_labels(spark):
    df = series(spark, [1.0], start=datetime(2006, 12, 16, 17))
    assert column(calendar_mean(df, P, "y", "W"), "ts") == [datetime(2006, 12, 17)]
    assert column(calendar_mean(df, P, "y", "ME"), "ts") == [datetime(2006, 12, 31)]
    assert column(calendar_mean(df, P, "y", "D"), "ts") == [datetime(2006, 12, 16)]


def test_validation_report(spark):
    df = union(series(spark, [-1.0, 60.0, None], MINUTE), series(spark, [5.0], MINUTE))
    report = quality.validate(df, P, ["y", "gone"], {"y": (0.0, 50.0)}, min_rows=10)
    got = {r.check_name: r.failed_rows for r in report.collect()}
    assert got == {
        "rows_present": 0, "null_key_or_time": 0, "missing_columns": 1, "non_numeric_columns": 0,
        "y_below_0": 1, "y_above_50": 1, "row_sufficiency": 6, "duplicate_timestamps": 1,
    }
    with pytest.raises(PanelError, match="y_above_50"):
        quality.require_valid(report)
    assert quality.fold_plan_rows(6, 365, 30, 60) == 784800


def test_infer_step(spark):
    assert [r.step_seconds for r in quality.infer_step(series(spark, [1.0] * 9, MINUTE), P).collect()] == [60.0]
    assert [r.step_seconds for r in quality.infer_step(series(spark, [1.0] * 9, MINUTE), P, first=3).collect()] == [60.0]


def test_preprocess_report(spark):
    df = series(spark, [1.0, None, 2.0] + [None] * 5 + [3.0] * 4, timedelta(minutes=15))
    row = impute.preprocess_report(df, Panel(freq="15min"), "1h", measures=["y"]).first().asDict()
    assert row == {
        "series_id": "a", "input_rows": 12, "target_frequency": "1h", "n_total_gaps": 2, "n_short_gaps_filled": 1,
        "n_long_gaps_preserved": 1, "longest_gap_rows": 5, "output_rows": 2, "rows_with_residual_null": 0,
    }


def test_preprocess_report_query_on_series_without_gaps(spark, tmp_path):
    import duckdb

    from chronopanel.queries import QUERIES, SQL

    quarter, hour = timedelta(minutes=15), timedelta(hours=1)
    rows = [("full", START + i * quarter, 20.0) for i in range(8)]
    rows += [("holes", START + i * quarter, 20.0) for i in (0, 1, 3, 4, 9)]
    rows += [("high missing", START + i * hour, 5.0) for i in range(3)]
    spark.createDataFrame(rows, "event_type string, ts timestamp_ntz, value double").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    found = QUERIES["a24_preprocess_report"](spark, str(tmp_path))
    want = con.execute(SQL["a24_preprocess_report"])
    assert found.columns == [c[0] for c in want.description]
    want = want.fetchall()
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    assert "full" not in {r[0] for r in want} and "holes" in {r[0] for r in want}
