"""Running totals and gapless numbers within groups of any size.

A window over a whole group would gather it in one task. Here the rows of a group are
dealt into buckets by a hash of their order key; totals per (group, bucket) are a partial
aggregate, their running total touches one row per bucket, and only rows of one bucket meet.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ROWS = 50_000


def buckets_for(rows: int) -> int:
    return max(1, math.ceil(rows / BUCKET_ROWS))


def running_start(df: DataFrame, group: list[str], order: list[Column], amount: str, buckets: int, name: str) -> DataFrame:
    """Add, per row, the sum of ``amount`` over the rows before it in its group.

    Rows are ordered by (bucket, order); rows that tie in ``order`` must be alike. ``group``
    columns may hold nulls.
    """
    src = df.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        src.groupBy(*group, "__b")
        .agg(F.sum(amount).alias("__sum"))
        .withColumn("__first", F.coalesce(F.sum("__sum").over(before), F.lit(0)))
        .select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__b").alias("__gb"), "__first")
    )
    inside = Window.partitionBy(*group, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    on = F.col("__b") == F.col("__gb")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    return (
        src.withColumn("__in", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .join(totals, on)
        .withColumn(name, F.col("__in") + F.col("__first"))
        .drop("__in", "__first", "__b", "__gb", *[f"__g{i}" for i in range(len(group))])
    )
