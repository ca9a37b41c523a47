"""Reading raw observations from delimited text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.operators.quality import POWER_MEASURES
from chronopanel.panel import PanelError

DAY_FIRST = "d/M/yyyy H:mm:ss"


def read_text(spark: SparkSession, path: str | Sequence[str], sep: str = ";", null_token: str = "?") -> DataFrame:
    """All columns as trimmed strings; the header names the columns.

    Spark takes the names from one file. Files whose own header differs in names or order are an error: their values would
    go to the wrong columns. Compare each with `match_columns` and union them by name instead.
    """
    reader = (
        spark.read.option("sep", sep).option("nullValue", null_token)
        .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    )
    df = reader.option("header", True).csv(path)
    # With a schema, `enforceSchema` makes each task hold its file's header against it, which costs no second read.
    return reader.option("header", True).option("enforceSchema", False).schema(df.schema).csv(path)


def match_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Select columns by name, ignoring case and surrounding blanks; missing ones are an error."""
    found = {c.strip().lower(): c for c in df.columns}
    missing = sorted(n for n in names if n.strip().lower() not in found)
    if missing:
        raise PanelError(f"missing columns {missing}; found {sorted(df.columns)}")
    return df.select(*[F.col(f"`{found[n.strip().lower()]}`").alias(n) for n in names])


def parse_times(df: DataFrame, date_col: str, time_col: str, fmt: str = DAY_FIRST, name: str = "ts") -> DataFrame:
    """Join date and time text into a timestamp; text that does not parse becomes null."""
    text = F.concat_ws(" ", F.trim(date_col), F.trim(time_col))
    parsed = F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")
    return df.select(parsed.alias(name), *[c for c in df.columns if c not in (date_col, time_col)])


def to_numbers(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Cast measures to double; text that is not a number, and NaN, become null."""
    def number(m: str):
        v = F.col(m).try_cast("double")
        return F.when(~F.isnan(v), v)

    return df.withColumns({m: number(m) for m in measures})


def parse_report(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows read and rows whose timestamp did not parse."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(ts).isNull()).alias("n_unparsed"))


def read_observations(
    spark: SparkSession,
    path: str | Sequence[str],
    sep: str = ";",
    null_token: str = "?",
    date_col: str = "Date",
    time_col: str = "Time",
    fmt: str = DAY_FIRST,
    measures: Sequence[str] = POWER_MEASURES,
    keys: Sequence[str] = (),
    strict: bool = True,
) -> DataFrame:
    """Typed observations; rows without a valid timestamp are dropped.

    ``strict`` fails when no timestamp parses; it stops reading at the first that does.
    """
    text = match_columns(read_text(spark, path, sep, null_token), [*keys, date_col, time_col, *measures])
    rows = to_numbers(parse_times(text, date_col, time_col, fmt), measures)
    good = rows.filter(F.col("ts").isNotNull())
    if strict and good.isEmpty():
        raise PanelError("no timestamp could be parsed; check the delimiter and the date format")
    return good
