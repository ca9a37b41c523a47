"""Text, tables, provenance, and the entry module."""

import importlib.util
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from chronopanel import Panel, PanelError
from chronopanel.sources import observations, tables
from tests.conftest import SMALL
from tests.helpers import column, same, seasonal_values, series, union

P = Panel()
HEADER = "Date; TIME ;global_active_power;Global_reactive_power;Voltage;Global_intensity;Sub_metering_1;Sub_metering_2;Sub_metering_3"


def write(tmp_path, *lines):
    path = tmp_path / "raw.txt"
    path.write_text("\n".join([HEADER, *lines]))
    return str(path)


def test_read_observations(spark, tmp_path):
    path = write(
        tmp_path, "16/12/2006;17:24:00;4.216;0.418;234.84;18.4;0;1;17", "16/12/2006;17:25:00;?;?;?;?;?;?;?",
        "1/2/2007;0:01:00; 1.5 ;abc;230;1;0;0;0", "no date;17:25:00;1;1;1;1;1;1;1",
    )
    rows = observations.read_observations(spark, path).orderBy("ts").collect()
    assert [r.ts for r in rows] == [datetime(2006, 12, 16, 17, 24), datetime(2006, 12, 16, 17, 25), datetime(2007, 2, 1, 0, 1)]
    assert rows[0].Global_active_power == 4.216 and rows[1].Voltage is None
    assert rows[2].Global_active_power == 1.5 and rows[2].Global_reactive_power is None


def test_bad_files_are_refused(spark, tmp_path):
    with pytest.raises(PanelError, match="no timestamp"):
        observations.read_observations(spark, write(tmp_path, "x;y;1;1;1;1;1;1;1"))
    (tmp_path / "short.txt").write_text("Date;Time\n1/1/2007;0:00:00")
    with pytest.raises(PanelError, match="Voltage"):
        observations.read_observations(spark, str(tmp_path / "short.txt"))


def test_panel_round_trip_and_provenance(spark, tmp_path):
    df = union(series(spark, seasonal_values(2000)), series(spark, seasonal_values(10), name="b"))
    path = str(tmp_path / "features")
    meta = tables.save_features(df, P, "y", path, {"lags": [1, 2]}).first()
    assert meta.n_rows == 2010 and meta.config_hash == tables.parameter_hash({"lags": [1, 2]})
    same(tables.load_features(spark, path, {"lags": [1, 2]}), df)
    with pytest.raises(PanelError, match="other parameters"):
        tables.load_features(spark, path, {"lags": [1]})
    month = tables.read_panel(spark, f"{path}/data", ["2008-01"])
    assert month.count() == 31 * 24 + 10
    assert tables.read_table(spark, f"{path}/data", ["y"]).columns == ["y"]


def test_models_lacking_a_fold_are_left_out(spark, tmp_path):
    base = series(spark, [1.0, 2.0]).select("series_id", "ts", F.col("y").alias("y_true"), F.col("y").alias("y_pred"))
    rows = [base.withColumns({"model": F.lit(m), "fold": F.lit(k)}) for m, k in (("a", 1), ("a", 2), ("b", 1))]
    tables.write_predictions(union(*rows), str(tmp_path / "p"))
    got = tables.read_predictions(spark, str(tmp_path / "p"), n_folds=2)
    assert {(r.model, r.fold) for r in got.collect()} == {("a", 1), ("a", 2)} and got.count() == 4


def test_entry_and_query_names(spark):
    out = entry_module.entry(spark)
    assert "MAE_mean" in out.columns and out.count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    # The optional packages add theirs only where they are there.
    added = {n for n in entry_module.queries() if n.startswith("op") or "pipeline" in n}
    there = {m for m in entry_module.OPTIONAL if importlib.util.find_spec(m)}
    assert ("pipeline" in added) == ("corpus_pipeline" in there)
    assert len(added - {"pipeline"}) == (10 if "chronopanel.llm" in there else 0)


@pytest.mark.parametrize("name", ["a3_gap_summary", "w4_fill_gaps", "a4_gap_quantiles", "f9_holiday_flag", "a9_segment_profile"])
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = entry_module.queries()[name](spark, SMALL).toPandas()
    want = con.execute(entry_module.oracle_sql()[name]).df()[list(got.columns)]
    show = lambda d: sorted(d.astype(object).where(d.notna(), None).astype(str).itertuples(index=False, name=None))
    assert show(got) == show(want)


def test_column_helper_orders_by_time(spark):
    assert column(series(spark, [2.0, 1.0]), "y") == [2.0, 1.0]
