"""Rolling-origin folds: the plan and the assignment of rows to folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.panel import Panel, PanelError
from chronopanel.plans.units import CHUNK, add_chunk, broadcast_if_small

N_FOLDS, TRAIN_DAYS, VALID_DAYS, GAP_DAYS = 6, 365, 30, 0
BOUNDS = ("train_start", "train_end", "valid_start", "valid_end")


def _shift(ts: Column, seconds: Column) -> Column:
    return (ts.cast("timestamp") + F.make_dt_interval(secs=seconds)).cast("timestamp_ntz")


def fold_plan(
    df: DataFrame,
    panel: Panel,
    n_folds: int = N_FOLDS,
    train_days: int = TRAIN_DAYS,
    valid_days: int = VALID_DAYS,
    gap_days: int = GAP_DAYS,
    step: str | None = None,
    strict: bool = True,
) -> DataFrame:
    """Folds per series, anchored at its last timestamp; fold 1 is the oldest.

    All bounds are inclusive at the grid step. A series whose span is too short
    fails the query in strict mode and gets no folds otherwise.
    """
    if min(n_folds, train_days, valid_days) < 1 or gap_days < 0:
        raise PanelError("fold sizes must be positive and the gap not negative")
    one = F.lit(panel.at(step).step if step else panel.step)
    day = 86400
    need = (train_days + n_folds * valid_days + gap_days) * day
    secs = lambda c: F.unix_seconds(c.cast("timestamp"))
    spans = df.groupBy(*panel.keys).agg(F.min(panel.ts).alias("__lo"), F.max(panel.ts).alias("__hi"))
    enough = secs(F.col("__hi")) - secs(F.col("__lo")) >= need
    if strict:
        short = F.raise_error(F.concat(
            F.lit("series "), F.concat_ws("/", *panel.keys), F.lit(f" spans less than the {need // day} days needed")
        ))
        spans = spans.filter(F.when(enough, F.lit(True)).otherwise(short.cast("boolean")))
    else:
        spans = spans.filter(enough)
    folds = spans.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(n_folds))))
    hi = F.col("__hi")
    end = (F.col("fold") - n_folds) * F.lit(valid_days * day)
    start = end - valid_days * day + one
    train_end = start - one - gap_days * day
    offsets = (train_end - train_days * day + one, train_end, start, end)
    return folds.select(*panel.keys, "fold", *[_shift(hi, o).alias(b) for b, o in zip(BOUNDS, offsets)])


def fold_status(
    df: DataFrame,
    panel: Panel,
    n_folds: int = N_FOLDS,
    train_days: int = TRAIN_DAYS,
    valid_days: int = VALID_DAYS,
    gap_days: int = GAP_DAYS,
    series: DataFrame | None = None,
) -> DataFrame:
    """Per series, whether the plan has folds for it: span, days needed, folds, and the reason where there are none.

    With ``strict=False`` `fold_plan` leaves the short series out; this table names every one of them. A matrix may have
    no row of a series; with ``series`` (any table with the keys) those come out as well, with no rows.
    """
    need = (train_days + n_folds * valid_days + gap_days) * 86400
    secs = lambda c: F.unix_seconds(c.cast("timestamp"))
    span = secs(F.max(panel.ts)) - secs(F.min(panel.ts))
    enough = F.col("span_seconds") >= need
    spans = df.groupBy(*panel.keys).agg(F.count(F.lit(1)).alias("n_rows"), span.alias("span_seconds"))
    if series is not None:
        spans = series.select(*panel.keys).distinct().join(spans, list(panel.keys), "left").fillna(0, ["n_rows", "span_seconds"])
    return spans.select(
        *panel.keys, "n_rows", (F.col("span_seconds") / 86400).alias("span_days"), F.lit(need / 86400).alias("needed_days"),
        F.when(enough, n_folds).otherwise(0).alias("n_folds"), F.when(~enough, F.lit("series too short")).alias("reason"),
    )


def assign_folds(df: DataFrame, panel: Panel, folds: DataFrame, roles: tuple[str, ...] = ("train", "valid")) -> DataFrame:
    """One row per (row, fold, role), with the window's start; a row may train several folds.

    A plan small enough to count is broadcast and matched on series and range;
    a large one is first spread over the time chunks it touches and joined on
    series and chunk, so neither hot series nor many folds meet in one task.
    """
    ts, keys = F.col(panel.ts), list(panel.keys)
    ranges = F.array(*[
        F.struct(F.lit(r).alias("role"), F.col(f"{r}_start").alias("lo"), F.col(f"{r}_end").alias("hi")) for r in roles
    ])
    plan = folds.select(*keys, "fold", F.explode(ranges).alias("__r")).select(*keys, "fold", "__r.*")
    inside = (ts >= F.col("lo")) & (ts <= F.col("hi"))
    per_series = plan.groupBy(*keys).agg(F.collect_list(F.struct("fold", "role", "lo", "hi")).alias("__folds"))

    small = broadcast_if_small(per_series)
    if small is None:
        chunk = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / panel.chunk_seconds).cast("bigint")
        spread = plan.withColumn(CHUNK, F.explode(F.sequence(chunk("lo"), chunk("hi"))))
        return add_chunk(df, panel).join(spread, [*keys, CHUNK]).filter(inside).withColumnRenamed("lo", "fold_from").drop(CHUNK, "hi")
    # One joined row per input row; only the folds that contain it are emitted.
    mine = F.filter("__folds", lambda f: (ts >= f["lo"]) & (ts <= f["hi"]))
    return (
        df.join(small, keys)
        .withColumn("__f", F.explode(mine))
        .withColumn("fold", F.col("__f.fold"))
        .withColumn("role", F.col("__f.role"))
        .withColumn("fold_from", F.col("__f.lo"))
        .drop("__folds", "__f")
    )


def fold_table(df: DataFrame, panel: Panel, folds: DataFrame, expected_step: str | None = None) -> DataFrame:
    """The plan with window lengths, row counts and validation completeness."""
    step = panel.at(expected_step).step if expected_step else panel.step
    keys = [*panel.keys, "fold"]
    counts = assign_folds(df.select(*panel.keys, panel.ts), panel, folds).groupBy(*keys).agg(
        F.count_if(F.col("role") == "train").alias("train_rows"),
        F.count_if(F.col("role") == "valid").alias("valid_rows"),
    )
    secs = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    length = lambda a, b: F.round((secs(b) - secs(a)) / 86400, 1)
    expected = F.floor((secs("valid_end") - secs("valid_start")) / step) + 1
    rows = F.coalesce("valid_rows", F.lit(0))
    return folds.join(counts, keys, "left").select(
        *keys,
        *BOUNDS,
        length("train_start", "train_end").alias("train_days"),
        length("valid_start", "valid_end").alias("valid_days"),
        F.coalesce("train_rows", F.lit(0)).alias("train_rows"),
        rows.alias("valid_rows"),
        F.round(rows / expected, 3).alias("valid_completeness"),
        (expected - rows).alias("missing_valid_rows"),
    )
