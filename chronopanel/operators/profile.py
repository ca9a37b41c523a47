"""Describing a panel: segments, distribution, rolling views, decomposition, anomalies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from chronopanel.functions.special import norm_quantile
from chronopanel.operators.evaluate import segments
from chronopanel.operators.quantiles import exact_quantiles
from chronopanel.panel import Panel, PanelError
from chronopanel.plans.units import CHUNK, add_chunk, attach, over_blocks
from chronopanel.session import materialize

SIGMAS = 2.0
TAIL_PROBS = (0.95, 0.99, 0.999)


# --- segments -----------------------------------------------------------------

def segment_profile(df: DataFrame, panel: Panel, value: str, decimals: int | None = 3) -> DataFrame:
    """Mean, sample deviation, minimum and maximum by hour, weekday and month."""
    stats = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    show = (lambda c: c) if decimals is None else (lambda c: F.round(c, decimals))
    long = df.filter(F.col(value).isNotNull()).select(
        *panel.keys, value, F.explode(segments(panel.ts)).alias("s")
    )
    return long.groupBy(
        *panel.keys, F.col("s.segment").alias("segment"), F.col("s.segment_value").alias("segment_value")
    ).agg(*[show(fn(value)).alias(n) for n, fn in stats.items()])


def heat_table(df: DataFrame, panel: Panel, value: str) -> DataFrame:
    """Mean by weekday (rows) and hour (columns h0..h23)."""
    wide = (
        df.withColumn("__hour", F.hour(panel.ts))
        .groupBy(*panel.keys, F.weekday(panel.ts).alias("day_of_week"))
        .pivot("__hour", list(range(24)))
        .agg(F.avg(value))
    )
    return wide.select(*panel.keys, "day_of_week", *[F.col(str(h)).alias(f"h{h}") for h in range(24)])


# --- distribution ---------------------------------------------------------------

def moments(df: DataFrame, keys: Sequence[str], value: str, above: float | None = None) -> DataFrame:
    """Skewness and excess kurtosis of the value and of log(1 + value), maximum, tail count."""
    log = F.log1p(F.col(value))
    aggs = [
        F.count(value).alias("n"),
        F.skewness(value).alias("skew"),
        F.kurtosis(value).alias("kurt"),
        F.skewness(log).alias("skew_log"),
        F.kurtosis(log).alias("kurt_log"),
        F.max(value).alias("max"),
    ]
    if above is not None:
        aggs.append(F.count_if(F.col(value) > above).alias("n_above"))
    return df.groupBy(*keys).agg(*aggs)


def tail_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float] = TAIL_PROBS) -> DataFrame:
    return exact_quantiles(df, keys, value, probs)


def histogram(df: DataFrame, panel: Panel, value: str | Column, bins: int, log_bins: bool = False) -> DataFrame:
    """Equal-width bins between each series' extremes; the maximum falls in the last bin.

    With ``log_bins`` the edges are equally spaced in log10 and only positive values count.
    """
    v = F.col(value) if isinstance(value, str) else value
    src = df.select(*panel.keys, panel.ts, (F.log10(v) if log_bins else v).alias("__v")).filter(F.col("__v").isNotNull())
    ends = src.groupBy(*panel.keys).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    lo, hi = F.col("__lo"), F.col("__hi")
    placed = attach(src, panel, ends)
    width = (hi - lo) / bins
    bin_no = F.when(width > 0, F.least(F.floor((F.col("__v") - lo) / width) + 1, F.lit(bins))).otherwise(1)
    edge = lo + (F.col("bin") - 1) * width
    unlog = (lambda c: F.pow(F.lit(10.0), c)) if log_bins else (lambda c: c)
    return (
        placed.withColumn("bin", bin_no.cast("int"))
        .groupBy(*panel.keys, "bin", "__lo", "__hi")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(*panel.keys, "bin", unlog(edge).alias("lower"), unlog(edge + width).alias("upper"), "n")
    )


def value_ranks(df: DataFrame, panel: Panel, value: str) -> DataFrame:
    """Add ``rank`` (1-based, by value then time) and ``n`` within each series.

    A row's rank is the number of smaller values, plus the equal values in
    earlier time chunks, plus its place among the equal values of its chunk.
    Smaller values are counted over distinct values, dealt by range into cells of
    some ``unit_rows`` of them, whatever the series: their number grows with the table, and splitters
    come from a sample. So neither a long series, an extreme value nor a value that most
    rows share is ever ordered in one task.
    """
    keys = list(panel.keys)
    src = add_chunk(df.filter(F.col(value).isNotNull()), panel)
    before = lambda part, order: Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    running = lambda c, part, order: F.coalesce(F.sum(c).over(before(part, order)), F.lit(0))

    per_chunk = src.groupBy(*keys, value, CHUNK).agg(F.count(F.lit(1)).alias("__c"))
    ties = per_chunk.withColumn("__earlier", running("__c", [*keys, value], CHUNK)).drop("__c")
    distinct = materialize(per_chunk.groupBy(*keys, value).agg(F.sum("__c").alias("__c")))
    cells = max(1, -(-distinct.count() // panel.unit_rows))
    # Stored, so that a value stays in the cell it was dealt to.
    placed = materialize(distinct.repartitionByRange(cells, *keys, value).withColumn("__cell", F.spark_partition_id()))
    whole = Window.partitionBy(*keys)
    # One row per cell that a series has values in.
    starts = placed.groupBy(*keys, "__cell").agg(F.sum("__c").alias("__c")).select(
        *keys, "__cell", running("__c", keys, "__cell").alias("__below"), F.sum("__c").over(whole).alias("n"))
    smaller = placed.join(starts, [*keys, "__cell"]).select(
        *keys, value, "n", (F.col("__below") + running("__c", [*keys, "__cell"], value)).alias("__smaller")
    )
    offsets = ties.join(smaller, [*keys, value])
    inside = Window.partitionBy(*keys, value, CHUNK).orderBy(panel.ts)
    return (
        src.withColumn("__rn", F.row_number().over(inside))
        .join(offsets, [*keys, value, CHUNK])
        .withColumn("rank", F.col("__smaller") + F.col("__earlier") + F.col("__rn"))
        .drop(CHUNK, "__rn", "__smaller", "__earlier")
    )


def qq_pairs(df: DataFrame, panel: Panel, value: str) -> DataFrame:
    """Ordered values against normal quantiles at Filliben's plotting positions."""
    ranked = value_ranks(df, panel, value)
    n, i = F.col("n").cast("double"), F.col("rank").cast("double")
    top = F.pow(F.lit(0.5), F.lit(1.0) / n)
    p = F.when(i == n, top).when(i == 1, 1 - top).otherwise((i - 0.3175) / (n + 0.365))
    return ranked.select(*panel.keys, panel.ts, "rank", F.col(value).alias("ordered"), norm_quantile(p).alias("theoretical"))


def describe(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max per column in long form."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in columns])
    long = df.select(*keys, F.explode(pairs).alias("e")).select(*keys, "e.*")
    on = [*keys, "column_name"]
    base = long.groupBy(*on).agg(
        F.count("v").alias("count"),
        (F.count("v") / F.count(F.lit(1))).alias("coverage"),
        F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
    )
    q = exact_quantiles(long, on, "v", [0.25, 0.5, 0.75])
    at = lambda p: F.max(F.when(F.col("p") == p, F.col("quantile")))
    wide = q.groupBy(*on).agg(at(0.25).alias("q25"), at(0.5).alias("q50"), at(0.75).alias("q75"))
    return base.join(wide, on, "left")


# --- dashboard summaries ----------------------------------------------------------

def kpis(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.max(value).alias("peak"), F.min(value).alias("low"), F.sum(value).alias("total")
    )


def weekend_gap(df: DataFrame, panel: Panel, value: str) -> DataFrame:
    """Weekend against weekday mean in percent, and the peak as a multiple of the mean."""
    weekend = F.weekday(panel.ts) >= 5
    end, mid = F.avg(F.when(weekend, F.col(value))), F.avg(F.when(~weekend, F.col(value)))
    return df.groupBy(*panel.keys).agg(
        end.alias("weekend_mean"),
        mid.alias("weekday_mean"),
        F.try_divide((end - mid) * 100, mid).alias("diff_pct"),
        F.try_divide(F.max(value), F.avg(value)).alias("peak_ratio"),
    )


def extremes(df: DataFrame, panel: Panel, value: str) -> DataFrame:
    """Largest and smallest value with the time each first occurs."""
    v, secs = F.col(value), F.unix_micros(F.col(panel.ts).cast("timestamp"))
    return df.filter(v.isNotNull()).groupBy(*panel.keys).agg(
        F.avg(v).alias("mean"),
        F.max(v).alias("peak"),
        F.max_by(panel.ts, F.struct(v, -secs)).alias("peak_at"),
        F.min(v).alias("trough"),
        F.min_by(panel.ts, F.struct(v, secs)).alias("trough_at"),
    )


def scenario(df: DataFrame, keys: Sequence[str], value: str, multiplier: float) -> DataFrame:
    """Effect of scaling the measure by 0.5 to 1.5."""
    if not 0.5 <= multiplier <= 1.5:
        raise PanelError("the multiplier must be between 0.5 and 1.5")
    mean = F.avg(value)
    return df.groupBy(*keys).agg(
        mean.alias("original_mean"),
        (mean * multiplier).alias("scenario_mean"),
        (mean * multiplier - mean).alias("impact"),
        F.try_divide((mean * multiplier - mean) * 100, mean).alias("impact_pct"),
    )


def anomalies(df: DataFrame, panel: Panel, value: str, sigmas: float = SIGMAS) -> DataFrame:
    """Flag values above mean + sigmas sample deviations of their series."""
    stats = df.groupBy(*panel.keys).agg(
        (F.avg(value) + sigmas * F.stddev_samp(value)).alias("threshold")
    )
    return attach(df, panel, stats).withColumn(
        "is_anomaly", F.coalesce((F.col(value) > F.col("threshold")).cast("tinyint"), F.lit(0).cast("tinyint"))
    )


# --- views over time ----------------------------------------------------------------

def difference(df: DataFrame, panel: Panel, value: str, name: str = "diff") -> DataFrame:
    """First difference of the non-null values; the first row of a series has none."""
    src = df.filter(F.col(value).isNotNull())
    return over_blocks(
        src, panel, lambda b, w: b.withColumn(name, F.col(value) - F.lag(value).over(w)), back=1
    )


def trailing_stats(
    df: DataFrame, panel: Panel, value: str, window: int = 168, min_rows: int | None = None,
    stats: Sequence[str] = ("mean", "std"),
) -> DataFrame:
    """Rolling statistics that include the current row; ``min_rows`` defaults to half the window."""
    need = window // 2 if min_rows is None else min_rows
    fns = {"mean": F.avg, "std": F.stddev_samp}

    def roll(blocks: DataFrame, w: WindowSpec) -> DataFrame:
        frame = w.rowsBetween(-(window - 1), 0)
        enough = F.count(value).over(frame) >= need
        return blocks.select("*", *[F.when(enough, fns[s](value).over(frame)).alias(f"roll_{s}_{window}") for s in stats])

    return over_blocks(df, panel, roll, back=window - 1)


def moving_average(df: DataFrame, panel: Panel, value: str, window: int = 7) -> DataFrame:
    """Trailing mean over a full window that includes the current row."""
    return trailing_stats(df, panel, value, window, min_rows=window, stats=("mean",)).withColumnRenamed(
        f"roll_mean_{window}", f"ma_{window}"
    )


def decompose(df: DataFrame, panel: Panel, value: str, period: int = 24) -> DataFrame:
    """Additive trend, seasonal and remainder columns.

    Trend is the centred moving average over one period (half weight on both
    ends when the period is even), the seasonal part the mean deviation of each
    phase, centred to sum to zero. Rows are taken as equally spaced.
    """
    half = period // 2

    def centred(blocks: DataFrame, w: WindowSpec) -> DataFrame:
        inner = w.rowsBetween(-half, half)
        full = F.count(value).over(inner) == 2 * half + 1
        total = F.sum(value).over(inner)
        if period % 2 == 0:
            ends = F.lag(value, half).over(w) + F.lead(value, half).over(w)
            total = total - ends / 2
        return blocks.withColumn("trend", F.when(full, total / period)).withColumn(
            "__phase", (F.col("__row") % period).cast("int")
        )

    src = over_blocks(df, panel, centred, back=half, ahead=half)
    phase = (
        src.groupBy(*panel.keys, "__phase")
        .agg(F.avg(F.col(value) - F.col("trend")).alias("__mean"))
    )
    # `period` rows per series.
    level = Window.partitionBy(*panel.keys)
    phase = phase.withColumn("__seasonal", F.col("__mean") - F.avg("__mean").over(level)).groupBy(*panel.keys).agg(
        F.map_from_entries(F.collect_list(F.struct("__phase", "__seasonal"))).alias("__season")
    )
    out = attach(src, panel, phase).withColumn("seasonal", F.col("__season")[F.col("__phase")])
    return out.withColumn("remainder", F.col(value) - F.col("trend") - F.col("seasonal")).drop("__phase", "__season")


def decomposition_summary(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    return parts.groupBy(*keys).agg(
        (F.max("seasonal") - F.min("seasonal")).alias("seasonal_amplitude"),
        F.min("trend").alias("trend_min"),
        F.max("trend").alias("trend_max"),
        F.stddev_samp("remainder").alias("remainder_std"),
    )


def time_range(df: DataFrame, panel: Panel, start: str, end: str) -> DataFrame:
    """Rows with start <= time <= end."""
    return df.filter(F.col(panel.ts).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def day_range(df: DataFrame, panel: Panel, first: str, last: str) -> DataFrame:
    """Rows from the first day to the end of the last day."""
    ts = F.col(panel.ts)
    return df.filter((ts >= F.lit(first).cast("timestamp_ntz")) & (ts < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp_ntz")))


def trailing_days(df: DataFrame, panel: Panel, days: int | None = None, months: int | None = None) -> DataFrame:
    """Rows of the last days or months before (and of) each series' last date."""
    ends = df.groupBy(*panel.keys).agg(F.to_date(F.max(panel.ts)).alias("__last"))
    start = F.add_months("__last", -months) if months is not None else F.date_sub("__last", days)
    ts = F.col(panel.ts)
    kept = attach(df, panel, ends).filter(
        (ts >= start.cast("timestamp_ntz")) & (ts < F.date_add("__last", 1).cast("timestamp_ntz"))
    )
    return kept.drop("__last")
