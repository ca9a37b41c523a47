"""Exact quantiles that stay bounded for groups of any size.

The built-in exact percentile keeps all distinct values of a group in one task.
Here a mergeable sketch first brackets each wanted rank; only the values inside
the brackets (a few parts in 100,000 of the group) are then counted and ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.plans.units import small_join

ACCURACY = 100_000


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Linear-interpolation quantiles: one row ``(keys, p, quantile)`` per probability. NaN counts as null."""
    if not keys:
        whole = exact_quantiles(df.withColumn("__all", F.lit(0)), ["__all"], value, probs)
        return whole.drop("__all")
    keys = list(keys)
    v = F.col(value).cast("double")
    data = df.select(*keys, F.when(~F.isnan(v), v).alias("__v")).filter(F.col("__v").isNotNull())
    # The sketch may be off by one cell, and its rank convention by one row.
    slack = 3.0 / ACCURACY
    lows = [max(0.0, p - slack) for p in probs]
    highs = [min(1.0, p + slack) for p in probs]
    brackets = data.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"),
        F.min("__v").alias("__min"),
        F.max("__v").alias("__max"),
        F.percentile_approx("__v", lows, ACCURACY).alias("__lo"),
        F.percentile_approx("__v", highs, ACCURACY).alias("__hi"),
    )
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    zipped = brackets.select(
        *keys, "__n", "__min", "__max",
        F.arrays_zip(wanted.alias("p"), F.col("__lo").alias("lo"), F.col("__hi").alias("hi")).alias("__q"),
    )

    def merged_first() -> DataFrame:
        # Too many groups to broadcast: merge equal values, then a shuffled join.
        return data.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__c")).join(zipped, keys)

    joined = small_join(data.withColumn("__c", F.lit(1)), zipped, keys, fallback=merged_first)
    q, whole = F.col("__q"), F.col("__n") <= ACCURACY
    lo, hi = F.when(whole, F.col("__min")).otherwise(q["lo"]), F.when(whole, F.col("__max")).otherwise(q["hi"])
    inside = (
        joined.withColumn("__q", F.explode("__q"))
        .filter(F.col("__v") <= hi)
        .groupBy(*keys, "__n", q["p"].alias("p"), F.when(F.col("__v") >= lo, F.col("__v")).alias("__v"))
        .agg(F.sum("__c").alias("__c"))
    )
    order = Window.partitionBy(*keys, "p").orderBy(F.col("__v").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, 0
    )
    ranked = inside.withColumn("__upto", F.sum("__c").over(order))
    h = (F.col("__n") - 1) * F.col("p")
    value_at = lambda rank: F.min(F.when(F.col("__upto") > rank, F.col("__v")))
    return (
        ranked.groupBy(*keys, "p")
        .agg(
            value_at(F.floor(h)).alias("__a"),
            value_at(F.ceil(h)).alias("__b"),
            F.first(h - F.floor(h)).alias("__w"),
            F.min(F.when(F.col("__v").isNull(), F.col("__upto") > F.floor(h))).alias("__missed"),
        )
        .select(
            *keys,
            "p",
            F.when(
                F.col("__b").isNull() | F.coalesce(F.col("__missed"), F.lit(False)),
                F.raise_error(F.lit("quantile bracket missed its rank")).cast("double"),
            )
            .otherwise(F.col("__a") + F.col("__w") * (F.col("__b") - F.col("__a")))
            .alias("quantile"),
        )
    )
