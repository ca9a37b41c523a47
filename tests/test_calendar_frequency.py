import pandas as pd
import pytest

from chronopanel.operators.quality import infer_calendar
from chronopanel.panel import Panel

# Frequency names, each the step of one series.
NAMES = ["15min", "h", "6h", "D", "3D", "W-WED", "2W-SUN", "MS", "ME", "2MS", "QS-OCT", "QE-DEC", "QE-NOV", "YS-APR", "YE-DEC", "BMS", "BME", "B", "s"]


@pytest.mark.parametrize("unit", [8192, 7])
def test_names(spark, unit):
    rows = [(n, t.to_pydatetime()) for n in NAMES for t in pd.date_range("2019-03-05 09:30", periods=40, freq=n)]
    rows += [("hole", t.to_pydatetime()) for i, t in enumerate(pd.date_range("2019-03-05", periods=40, freq="D")) if i != 20]
    rows += [("two times of day", pd.Timestamp(f"2020-{m:02d}-01 0{m % 2}:00").to_pydatetime()) for m in range(1, 10)]
    rows += [("two rows", pd.Timestamp(f"2020-01-0{d}").to_pydatetime()) for d in (1, 2)]
    rows += [("twice", pd.Timestamp("2020-01-01").to_pydatetime())] * 3
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz")
    got = {r["series_id"]: r["frequency"] for r in infer_calendar(df, Panel(freq="1D", unit_rows=unit)).collect()}
    assert {n: got[n] for n in NAMES} == {n: n for n in NAMES}
    assert [got[n] for n in ("hole", "two times of day", "two rows", "twice")] == [None] * 4


def test_empty_table(spark):
    assert infer_calendar(spark.createDataFrame([], "series_id string, ts timestamp_ntz"), Panel(freq="1D")).count() == 0
