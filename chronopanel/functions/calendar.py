"""Calendar, cyclical and public-holiday expressions (Monday is day 0)."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CALENDAR_NAMES = ("hour", "day_of_week", "day_of_month", "day_of_year", "month", "quarter", "is_weekend")
CYCLICAL_NAMES = ("hour_sin", "hour_cos", "day_of_week_sin", "day_of_week_cos", "month_sin", "month_cos")

# French public holidays, as month-day dates and as days after Easter Sunday.
FRENCH_FIXED_DATES = {
    "New Year": "01-01",
    "Labour Day": "05-01",
    "Victory Day": "05-08",
    "Bastille Day": "07-14",
    "Assumption": "08-15",
    "All Saints": "11-01",
    "Armistice": "11-11",
    "Christmas": "12-25",
}
FRENCH_EASTER_OFFSETS = {"Easter Monday": 1, "Ascension": 39, "Whit Monday": 50}


def calendar_columns(ts: str) -> list[Column]:
    t = F.col(ts)
    dow = F.weekday(t)
    values = (F.hour(t), dow, F.dayofmonth(t), F.dayofyear(t), F.month(t), F.quarter(t), (dow >= 5).cast("int"))
    types = {"day_of_year": "smallint"}
    return [v.cast(types.get(n, "tinyint")).alias(n) for n, v in zip(CALENDAR_NAMES, values)]


def cyclical_columns(ts: str) -> list[Column]:
    t = F.col(ts)
    phases = {
        "hour": F.hour(t) / F.lit(24.0),
        "day_of_week": F.weekday(t) / F.lit(7.0),
        "month": (F.month(t) - 1) / F.lit(12.0),
    }
    return [
        fn(F.lit(2 * math.pi) * phase).cast("float").alias(f"{name}_{label}")
        for name, phase in phases.items()
        for label, fn in (("sin", F.sin), ("cos", F.cos))
    ]


def easter_sunday(year: Column) -> Column:
    """Gregorian Easter (the anonymous computus), as a date."""
    div = lambda x, n: F.floor(x / F.lit(n)).cast("int")
    a, b, c = year % 19, div(year, 100), year % 100
    h = (19 * a + b - div(b, 4) - div(b - div(b + 8, 25) + 1, 3) + 15) % 30
    l = (32 + 2 * (b % 4) + 2 * div(c, 4) - h - c % 4) % 7  # noqa: E741
    m = div(a + 11 * h + 22 * l, 451)
    days = h + l - 7 * m + 114
    return F.make_date(year, div(days, 31), days % 31 + 1)


def holiday_flag(
    ts: str,
    fixed: Mapping[str, str] = FRENCH_FIXED_DATES,
    easter_offsets: Mapping[str, int] = FRENCH_EASTER_OFFSETS,
    name: str = "is_french_holiday",
) -> Column:
    """1 on a holiday, else 0. A function of the date alone, so no join is needed."""
    day = F.to_date(F.col(ts))
    after_easter = F.datediff(day, easter_sunday(F.year(day)))
    on_fixed = F.date_format(day, "MM-dd").isin(sorted(fixed.values()))
    on_moving = after_easter.isin(sorted(easter_offsets.values()))
    return (on_fixed | on_moving).cast("tinyint").alias(name)


def holiday_dates(
    days: DataFrame,
    fixed: Mapping[str, str] = FRENCH_FIXED_DATES,
    easter_offsets: Mapping[str, int] = FRENCH_EASTER_OFFSETS,
) -> DataFrame:
    """The holiday dimension ``(holiday_date, holiday)`` for every year in ``days.day``."""
    years = days.select(F.year("day").alias("y")).distinct()
    y = F.col("y")
    entries = [
        F.struct(F.to_date(F.concat_ws("-", y.cast("string"), F.lit(md))).alias("d"), F.lit(n).alias("n"))
        for n, md in fixed.items()
    ] + [
        F.struct(F.date_add(easter_sunday(y), off).alias("d"), F.lit(n).alias("n"))
        for n, off in easter_offsets.items()
    ]
    return years.select(F.explode(F.array(*entries)).alias("e")).select(
        F.col("e.d").alias("holiday_date"), F.col("e.n").alias("holiday")
    )


def week_label(ts: str) -> Column:
    """Sunday that closes the Monday-to-Sunday week."""
    return F.date_add(F.date_trunc("week", F.col(ts)).cast("date"), 6).cast("timestamp_ntz")


def month_label(ts: str) -> Column:
    """Last day of the month."""
    return F.last_day(F.col(ts)).cast("timestamp_ntz")


def day_label(ts: str) -> Column:
    return F.to_date(F.col(ts)).cast("timestamp_ntz")
