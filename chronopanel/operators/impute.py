"""Past-only gap filling and seasonal-mean imputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from chronopanel.operators.quality import SHORT_GAP_ROWS, any_null, gap_summary
from chronopanel.operators.resample import resample
from chronopanel.panel import Panel, PanelError, missing_as_null
from chronopanel.plans.units import over_blocks, small_join


def fill_gaps(
    df: DataFrame,
    panel: Panel,
    measures: Sequence[str] | None = None,
    k: int = SHORT_GAP_ROWS,
    remask: bool = True,
) -> DataFrame:
    """Forward-fill gaps of up to k rows; null out and flag longer ones.

    A row is missing when any measure is null or NaN. Whether its run is longer than
    k shows within k rows on either side, so blocks with that halo are exact.
    With ``remask=False`` the first k rows of a long gap keep their fill.
    Adds ``is_originally_missing`` and ``is_outage_gap``.
    """
    if k < 1:
        raise PanelError("k must be at least 1")
    measures = list(panel.measures_of(df) if measures is None else measures)

    df = missing_as_null(df, measures)

    def policy(blocks: DataFrame, w: WindowSpec) -> DataFrame:
        # The nearest present row before and after, within k+1 rows, bounds the run.
        row = F.when(~F.col("__m"), F.col("__row"))
        prev = F.max(row).over(w.rowsBetween(-k, 0))
        nxt = F.min(row).over(w.rowsBetween(0, k))
        first = F.min("__row").over(w.rowsBetween(-k, 0))
        last = F.max("__row").over(w.rowsBetween(0, k))
        marked = blocks.withColumn("__m", any_null(measures)).withColumns(
            {"__prev": prev, "__next": nxt, "__first": first, "__last": last}
        )
        run = F.coalesce(F.col("__next") - 1, "__last") - F.coalesce(F.col("__prev") + 1, "__first") + 1
        outage = F.col("__m") & (run > k)
        filled = {}
        for m in measures:
            fill = F.coalesce(F.col(m), F.last(m, ignorenulls=True).over(w.rowsBetween(-k, 0)))
            filled[m] = F.when(~F.col("__o"), fill) if remask else fill
        return (
            marked.withColumn("__o", outage)
            .withColumns(filled)
            .withColumn("is_originally_missing", F.col("__m").cast("tinyint"))
            .withColumn("is_outage_gap", F.col("__o").cast("tinyint"))
            .drop("__m", "__o", "__prev", "__next", "__first", "__last")
        )

    return over_blocks(df, panel, policy, back=k, ahead=k)


def seasonal_mean_fill(df: DataFrame, panel: Panel, measure: str) -> DataFrame:
    """Replace nulls by the series' mean at the same hour of day.

    Only the 24 means per series are joined back, not a window over the series.
    """
    hour = F.hour(panel.ts).cast("int")
    keyed = missing_as_null(df, [measure]).withColumn("__hour", hour)
    means = keyed.groupBy(*panel.keys, "__hour").agg(F.avg(measure).alias("__mean"))
    on = [*panel.keys, "__hour"]

    def by_day() -> DataFrame:
        day = F.to_date(panel.ts)
        src = keyed.withColumn("__day", day)
        per_day = src.select(*on, "__day").distinct().join(means, on)
        return src.join(per_day, [*on, "__day"]).drop("__day")

    out = small_join(keyed, means, on, fallback=by_day)
    return out.withColumn(measure, F.coalesce(measure, "__mean")).drop("__hour", "__mean")


def preprocess(
    df: DataFrame, panel: Panel, freq: str, how: str = "mean", k: int = SHORT_GAP_ROWS,
    measures: Sequence[str] | None = None,
) -> DataFrame:
    """Gap policy at the native spacing, then downsampling."""
    measures = list(panel.measures_of(df) if measures is None else measures)
    return resample(fill_gaps(df, panel, measures, k), panel, freq, how, measures)


def preprocess_report(
    df: DataFrame, panel: Panel, freq: str, how: str = "mean", k: int = SHORT_GAP_ROWS,
    measures: Sequence[str] | None = None,
) -> DataFrame:
    """Per series: rows in and out, gap counts, longest gap, rows still null."""
    measures = list(panel.measures_of(df) if measures is None else measures)
    keys = list(panel.keys)
    gaps = gap_summary(df, panel, measures).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_total_gaps"),
        F.count_if(F.col("length") <= k).alias("n_short_gaps_filled"),
        F.count_if(F.col("length") > k).alias("n_long_gaps_preserved"),
        F.max("length").alias("longest_gap_rows"),
    )
    df = missing_as_null(df, measures)
    rows_in = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("input_rows"))
    rows_out = preprocess(df, panel, freq, how, k, measures).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("output_rows"),
        F.count_if(any_null(measures)).alias("rows_with_residual_null"),
    )
    counts = ("n_total_gaps", "n_short_gaps_filled", "n_long_gaps_preserved", "longest_gap_rows",
              "output_rows", "rows_with_residual_null")
    out = rows_in.join(rows_out, keys, "left").join(gaps, keys, "left")
    return out.select(
        *keys, "input_rows", F.lit(freq).alias("target_frequency"),
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts],
    )
