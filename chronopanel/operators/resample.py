"""Downsampling to a fixed grid and calendar periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.functions.calendar import day_label, month_label, week_label
from chronopanel.operators.quantiles import exact_quantiles
from chronopanel.panel import AGGREGATIONS, FLAGS, Panel, PanelError, missing_as_null, step_seconds


def bucket_start(ts: str, freq: str) -> Column:
    """Start of the grid bucket; buckets are aligned to midnight."""
    return F.window(F.col(ts), f"{step_seconds(freq)} seconds").getField("start")


def grid(df: DataFrame, panel: Panel, freq: str) -> DataFrame:
    """Every bucket between the first and last observation of each series.

    The span is expanded in two steps, so that no array grows with the length
    of a series: first one row per day range, then the buckets inside it.
    """
    step = step_seconds(freq)
    stride = step * 1024
    secs = lambda c: F.unix_seconds(c.cast("timestamp"))
    b = bucket_start(panel.ts, freq)
    spans = (
        df.select(*panel.keys, b.alias("__b"))
        .groupBy(*panel.keys)
        .agg(secs(F.min("__b")).alias("__lo"), secs(F.max("__b")).alias("__hi"))
    )
    pieces = spans.withColumn("__from", F.explode(F.sequence("__lo", "__hi", F.lit(stride))))
    last = F.least(F.col("__from") + stride - step, F.col("__hi"))
    return pieces.select(
        *panel.keys, F.explode(F.sequence(F.col("__from"), last, F.lit(step))).alias("__s")
    ).select(*panel.keys, F.timestamp_seconds("__s").cast("timestamp_ntz").alias(panel.ts))


def _aggregate(how: str, name: str, ts: str) -> Column:
    c = F.col(name)
    if how == "mean":
        return F.avg(c).alias(name)
    if how == "sum":
        return F.coalesce(F.sum(c.cast("double")), F.lit(0.0)).alias(name)
    by = F.when(c.isNotNull(), F.col(ts))
    return (F.min_by if how == "first" else F.max_by)(c, by).alias(name)


def resample(
    df: DataFrame,
    panel: Panel,
    freq: str,
    how: str = "mean",
    measures: Sequence[str] | None = None,
    flags: Sequence[str] | None = None,
    dense: bool = False,
) -> DataFrame:
    """Aggregate measures into buckets; flags take the maximum.

    A bucket whose measures are all null is dropped, unless ``dense`` asks for
    every bucket of the span. A sum over nulls is 0. ``dense`` feeds the empty
    grid into the same aggregation, which avoids a join.
    """
    if how not in AGGREGATIONS:
        raise PanelError(f"unknown aggregation {how!r}; use one of {AGGREGATIONS}")
    measures = list(panel.measures_of(df) if measures is None else measures)
    flags = [f for f in FLAGS if f in df.columns] if flags is None else list(flags)
    if not measures and not flags:
        raise PanelError("no measure or flag columns to resample")
    src = missing_as_null(df.select(*panel.keys, panel.ts, *measures, *flags), measures)
    keys = [F.col(k) for k in panel.keys]
    bucket = bucket_start(panel.ts, freq).alias("__bucket")
    if dense:
        src = src.unionByName(grid(df, panel, freq), allowMissingColumns=True)
    flag_aggs = [F.max(f).cast("tinyint").alias(f) for f in flags]
    if how == "median" and measures:
        bucketed = src.withColumn("__bucket", bucket)
        out = bucketed.groupBy(*panel.keys, "__bucket").agg(F.count(F.lit(1)).alias("__n"), *flag_aggs)
        for m in measures:
            med = exact_quantiles(bucketed, [*panel.keys, "__bucket"], m, [0.5])
            out = out.join(
                med.select(*panel.keys, "__bucket", F.col("quantile").alias(m)), [*panel.keys, "__bucket"], "left"
            )
        out = out.select(*panel.keys, F.col("__bucket").alias(panel.ts), *measures, *flags)
    else:
        out = (
            src.groupBy(*keys, bucket)
            .agg(*[_aggregate(how, m, panel.ts) for m in measures], *flag_aggs)
            .select(*panel.keys, F.col("__bucket").alias(panel.ts), *measures, *flags)
        )
    if measures and not dense:
        out = out.dropna("all", subset=measures)
    return out


PERIODS = {"W": week_label, "D": day_label, "ME": month_label}


def calendar_mean(df: DataFrame, panel: Panel, measure: str, period: str) -> DataFrame:
    """Mean per calendar period: "W" (Sunday label), "D", "ME" (month end) or "h"."""
    if period == "h":
        label = bucket_start(panel.ts, "1h")
    elif period in PERIODS:
        label = PERIODS[period](panel.ts)
    else:
        raise PanelError(f"unknown period {period!r}")
    keys = [F.col(k) for k in panel.keys]
    return (
        missing_as_null(df, [measure]).groupBy(*keys, label.alias("__p"))
        .agg(F.avg(measure).alias("value"))
        .select(*panel.keys, F.col("__p").alias(panel.ts), "value")
    )
