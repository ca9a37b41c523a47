"""Validation, missingness and gaps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.operators.evaluate import first_n
from chronopanel.operators.quantiles import exact_quantiles
from chronopanel.panel import Panel, PanelError, missing_as_null, need_columns
from chronopanel.plans.units import CHUNK, add_chunk, chunk_window, over_blocks

# The columns of the household power panel and their plausible ranges.
POWER_MEASURES = (
    "Global_active_power", "Global_reactive_power", "Voltage", "Global_intensity",
    "Sub_metering_1", "Sub_metering_2", "Sub_metering_3",
)
POWER_BOUNDS = {"Global_active_power": (0.0, 50.0), "Voltage": (100.0, 300.0)}
SHORT_GAP_ROWS = 3


def any_null(measures: Sequence[str]) -> Column:
    if not measures:
        raise PanelError("no measure columns")
    out = F.col(measures[0]).isNull()
    for m in measures[1:]:
        out = out | F.col(m).isNull()
    return out


def all_null(measures: Sequence[str]) -> Column:
    out = F.col(measures[0]).isNull()
    for m in measures[1:]:
        out = out & F.col(m).isNull()
    return out


nan_to_null = missing_as_null


# --- validation ---------------------------------------------------------------

def validate(
    df: DataFrame,
    panel: Panel,
    measures: Sequence[str],
    bounds: Mapping[str, tuple[float | None, float | None]] | None = None,
    min_rows: int | None = None,
) -> DataFrame:
    """One row ``(check_name, failed_rows, message)`` per check; 0 failed rows is a pass.

    Schema checks come from the frame's types; everything else is one
    aggregation, except duplicates, which count rows per key and timestamp.
    """
    present = [m for m in measures if m in df.columns]
    types = dict(df.dtypes)
    numeric = [m for m in present if m in panel.measures_of(df.select(m))]
    bounds = dict(bounds or {})
    per_series = None
    aggs: list[tuple[str, Column, str]] = [
        ("rows_present", (F.count(F.lit(1)) == 0).cast("bigint"), "the frame has no rows"),
        ("null_key_or_time", F.count_if(any_null([*panel.keys, panel.ts])), "null series key or timestamp"),
        ("missing_columns", F.lit(len(measures) - len(present)).cast("bigint"), "required columns absent"),
        ("non_numeric_columns", F.lit(len(present) - len(numeric)).cast("bigint"), "measure columns not numeric"),
    ]
    for m, (lo, hi) in bounds.items():
        if m not in numeric:
            continue
        if lo is not None:
            aggs.append((f"{m}_below_{lo:g}", F.count_if(F.col(m) < lo), f"values under {lo:g}"))
        if hi is not None:
            aggs.append((f"{m}_above_{hi:g}", F.count_if(F.col(m) > hi), f"values over {hi:g}"))
    if min_rows is not None:
        short = F.sum(F.greatest(F.lit(min_rows) - F.col("__rows"), F.lit(0)))
        per_series = ("row_sufficiency", short, f"rows that series are short of the {min_rows} each that the fold plan needs")
    entries = [
        F.struct(F.lit(n).alias("check_name"), F.coalesce(c, F.lit(0)).cast("bigint").alias("failed_rows"),
                 F.lit(msg).alias("message"))
        for n, c, msg in aggs
    ]
    battery = df.agg(F.array(*entries).alias("e")).select(F.explode("e").alias("e")).select("e.*")
    repeats = (
        df.groupBy(*panel.keys, panel.ts)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("failed_rows"))
        .select(F.lit("duplicate_timestamps").alias("check_name"), "failed_rows",
                F.lit("repeated timestamps within a series").alias("message"))
    )
    out = battery.unionByName(repeats)
    if per_series:
        name, failed, message = per_series
        rows = df.groupBy(*panel.keys).agg(F.count(F.lit(1)).alias("__rows"))
        # Without any row, one series is short by all of them.
        failed = rows.agg(F.coalesce(failed, F.lit(min_rows)).cast("bigint").alias("failed_rows"))
        out = out.unionByName(failed.select(F.lit(name).alias("check_name"), "failed_rows", F.lit(message).alias("message")))
    return out


def validation_summary(df: DataFrame, panel: Panel, measures: Sequence[str]) -> DataFrame:
    """Per series: rows, rows with a missing measure, first and last time."""
    return missing_as_null(df, measures).groupBy(*panel.keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(any_null(measures)).alias("rows_with_missing"),
        F.min(panel.ts).alias("first_time"), F.max(panel.ts).alias("last_time"),
    )


def require_valid(report: DataFrame) -> None:
    """Raise when any check of a `validate` report failed."""
    failed = report.filter("failed_rows > 0").collect()
    if failed:
        raise PanelError("; ".join(f"{r.check_name}: {r.failed_rows} ({r.message})" for r in failed))


def fold_plan_rows(n_folds: int, train_days: int, valid_days: int, step: int) -> int:
    """Rows a series must have for the fold plan, at one row per step."""
    return (train_days + n_folds * valid_days) * 86400 // step


# --- missingness --------------------------------------------------------------

def column_audit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: type, missing percentage, distinct count, and of values that are numbers minimum, median, maximum."""
    types = dict(df.dtypes)
    df = missing_as_null(df.select(*columns), columns)
    floats = ("double", "float")
    # Distinct values are told apart by their text, which keeps long integers exact; numbers as such give the rest.
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(types[c]).alias("dtype"),
                 (F.col(c).cast("double") if types[c] in floats or types[c].startswith("decimal") else F.col(c).try_cast("double")).alias("v"),
                 F.col(c).cast("string").alias("t")) for c in columns
    ])
    long = df.select(F.explode(pairs).alias("e")).select("e.*")
    # Counting per distinct value first keeps the distinct count mergeable.
    stats = (
        long.groupBy("column_name", "dtype", "v", "t")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("column_name", "dtype")
        .agg(
            (F.sum(F.when(F.col("t").isNull(), F.col("n")).otherwise(0)) / F.sum("n") * 100).alias("missing_pct"),
            F.count("t").alias("n_unique"),
            F.min("v").alias("min"),
            F.max("v").alias("max"),
        )
    )
    medians = exact_quantiles(long, ["column_name"], "v", [0.5]).select("column_name", F.col("quantile").alias("median"))
    return stats.join(medians, "column_name", "left").select(
        "column_name", "dtype", "missing_pct", "n_unique", "min", "median", "max"
    )


def missing_rows(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Rows with any / all measures null, and whether all measures share one null mask."""
    df = missing_as_null(df, measures)
    n_null = sum((F.col(m).isNull().cast("int") for m in measures), F.lit(0))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(n_null > 0).alias("rows_any_missing"),
        F.count_if(n_null == len(measures)).alias("rows_all_missing"),
        (F.count_if((n_null > 0) & (n_null < len(measures))) == 0).alias("same_mask"),
        F.try_divide(F.count_if(n_null > 0) * 100.0, F.count(F.lit(1))).alias("missing_pct"),
    )


def missing_rate(df: DataFrame, panel: Panel, measures: Sequence[str]) -> DataFrame:
    """Missing-row percentage by hour, weekday and calendar month, in one pass."""
    flagged = missing_as_null(df, measures).select(
        *panel.keys,
        F.hour(panel.ts).alias("hour"),
        F.weekday(panel.ts).alias("dow"),
        F.date_format(F.last_day(panel.ts), "yyyy-MM-dd").alias("month"),
        any_null(measures).cast("double").alias("missing"),
    )
    segment = F.array(
        *[F.struct(F.lit(n).alias("segment"), F.col(n).cast("string").alias("value")) for n in ("hour", "dow", "month")]
    )
    # Counting per cell first makes the expansion into three segments cheap.
    cells = flagged.groupBy(*panel.keys, "hour", "dow", "month").agg(
        F.sum("missing").alias("m"), F.count(F.lit(1)).alias("n")
    )
    return (
        cells.select(*panel.keys, "m", "n", F.explode(segment).alias("s"))
        .groupBy(*panel.keys, F.col("s.segment").alias("segment"), F.col("s.value").alias("segment_value"))
        .agg((F.sum("m") / F.sum("n") * 100).alias("missing_pct"), F.sum("n").alias("n_rows"))
    )


def missing_rate_summary(rates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The worst month of each series and the spread of its monthly rates."""
    month = F.col("segment") == "month"
    return (
        rates.filter(month)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_months"),
            F.avg("missing_pct").alias("mean_pct"),
            F.stddev_samp("missing_pct").alias("std_pct"),
            F.min("missing_pct").alias("min_pct"),
            # One number per month: the built-in exact percentile holds few values.
            *[F.percentile("missing_pct", q / 100).alias(f"p{q}_pct") for q in (25, 50, 75)],
            F.max("missing_pct").alias("max_pct"),
            F.max_by("segment_value", F.struct(F.col("missing_pct"), F.col("segment_value"))).alias("worst_month"),
        )
    )


def worst_hours(rates: DataFrame, keys: Sequence[str], n: int = 5) -> DataFrame:
    """The n hours of day with the highest missing percentage; ties go to the earlier hour."""
    hour = F.col("segment_value").cast("int")
    w = Window.partitionBy(*keys).orderBy(F.col("missing_pct").desc(), "hour")  # 24 rows a series
    return (
        rates.filter(F.col("segment") == "hour").select(*keys, hour.alias("hour"), "missing_pct", "n_rows")
        .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    )


# --- gaps ---------------------------------------------------------------------

_ISLAND, _ID, _MISSING = "__island", "__gap", "__missing"


def _mark_islands(df: DataFrame, panel: Panel, missing: Column) -> DataFrame:
    """Runs of missing rows inside each chunk. Rows between two runs share no island."""
    w = chunk_window(panel)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    marked = add_chunk(df, panel).withColumn(_MISSING, missing)
    return marked.withColumns(
        {
            "__rn": F.row_number().over(w),
            _ISLAND: F.when(
                F.col(_MISSING), F.row_number().over(w) - F.sum(F.col(_MISSING).cast("int")).over(so_far)
            ).otherwise(-1),
        }
    )


def _chunk_runs(marked: DataFrame, panel: Panel) -> DataFrame:
    """One row per run and chunk, plus one row (island -1) for the chunk's present rows."""
    per_chunk = Window.partitionBy(*panel.keys, CHUNK)
    runs = marked.groupBy(*panel.keys, CHUNK, _ISLAND).agg(
        F.min(panel.ts).alias("start"),
        F.max(panel.ts).alias("end"),
        F.count(F.lit(1)).alias("length"),
        F.min("__rn").alias("__first"),
        F.max("__rn").alias("__last"),
    )
    return runs.withColumns(
        {
            "__head": (F.col("__first") == 1) & (F.col(_ISLAND) >= 0),
            "__tail": (F.col("__last") == F.max("__last").over(per_chunk)) & (F.col(_ISLAND) >= 0),
        }
    )


def _join_edges(runs: DataFrame, panel: Panel) -> DataFrame:
    """Number the runs that continue across chunk edges; at most three rows per chunk."""
    edges = runs.filter((F.col(_ISLAND) < 0) | F.col("__head") | F.col("__tail"))
    # The present-rows marker only tells which chunks exist, so that "the chunk before" is known.
    numbered = edges.withColumn(
        "__nth", F.dense_rank().over(Window.partitionBy(*panel.keys).orderBy(CHUNK))
    ).filter(F.col(_ISLAND) >= 0)
    by_time = Window.partitionBy(*panel.keys).orderBy(CHUNK, "__first")
    continues = (
        F.col("__head")
        & F.lag("__tail").over(by_time)
        & (F.lag("__nth").over(by_time) == F.col("__nth") - 1)
    )
    return numbered.withColumn("__new", F.when(continues, 0).otherwise(1)).withColumn(
        _ID, F.sum("__new").over(by_time.rowsBetween(Window.unboundedPreceding, 0))
    )


def gap_summary(df: DataFrame, panel: Panel, measures: Sequence[str]) -> DataFrame:
    """Runs of consecutive rows with any null measure: ``(keys, start, end, length)``.

    Runs are found inside time chunks; only runs that touch a chunk edge are
    joined up across chunks, so a long series needs no single-task pass.
    """
    need_columns(df, [*panel.keys, panel.ts, *measures])
    slim = missing_as_null(df, measures).select(*panel.keys, panel.ts, any_null(measures).alias(_MISSING))
    runs = _chunk_runs(_mark_islands(slim, panel, F.col(_MISSING)), panel)
    columns = [*panel.keys, "start", "end", "length"]
    inner = runs.filter((F.col(_ISLAND) >= 0) & ~F.col("__head") & ~F.col("__tail")).select(*columns)
    merged = (
        _join_edges(runs, panel)
        .groupBy(*panel.keys, _ID)
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("length").alias("length"))
        .select(*columns)
    )
    return inner.unionByName(merged)


def gap_lengths(df: DataFrame, panel: Panel, measures: Sequence[str], short: int = SHORT_GAP_ROWS) -> DataFrame:
    """Add each row's gap length (0 when present) and whether it is in a long gap."""
    marked = _mark_islands(missing_as_null(df, measures), panel, any_null(measures))
    runs = _chunk_runs(marked, panel)
    edge = _join_edges(runs, panel)
    total = edge.withColumn("__total", F.sum("length").over(Window.partitionBy(*panel.keys, _ID))).select(
        *panel.keys, CHUNK, _ISLAND, "__total"
    )
    in_chunk = F.count(F.lit(1)).over(Window.partitionBy(*panel.keys, CHUNK, _ISLAND))
    out = marked.withColumn("__here", in_chunk).join(total, [*panel.keys, CHUNK, _ISLAND], "left")
    length = F.when(F.col(_MISSING), F.coalesce("__total", "__here")).otherwise(0).cast("bigint")
    return (
        out.withColumn("gap_length", length)
        .withColumn("in_long_gap", (F.col("gap_length") > short).cast("tinyint"))
        .drop(CHUNK, _ISLAND, _MISSING, "__rn", "__here", "__total")
    )


def gap_stats(gaps: DataFrame, keys: Sequence[str], short: int = SHORT_GAP_ROWS) -> DataFrame:
    """Counts of short and long gaps and the longest one, per series."""
    longest = F.struct(F.col("length"), F.col("start"))
    return gaps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_gaps"),
        F.count_if(F.col("length") <= short).alias("n_short"),
        F.count_if(F.col("length") > short).alias("n_long"),
        F.sum("length").alias("missing_rows"),
        F.avg("length").alias("mean_length"),
        F.max("length").alias("longest"),
        F.max_by("start", longest).alias("longest_start"),
        F.max_by("end", longest).alias("longest_end"),
    )


def gap_quantiles(gaps: DataFrame, keys: Sequence[str], probs: Sequence[float] = (0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    return exact_quantiles(gaps, keys, "length", probs)


def longest_gaps(gaps: DataFrame, n: int = 10) -> DataFrame:
    """The n longest gaps; ties go to the earlier start."""
    return gaps.orderBy(F.col("length").desc(), F.col("start"), *[c for c in gaps.columns if c not in ("start", "end", "length")]).limit(n)


def infer_step(df: DataFrame, panel: Panel, first: int | None = None) -> DataFrame:
    """Most frequent spacing of consecutive rows in seconds (smaller one on a tie).

    ``first`` looks only at that many leading rows of every series.
    """
    def spacing(blocks: DataFrame, w) -> DataFrame:
        seconds = F.unix_micros(F.col(panel.ts).cast("timestamp")) / F.lit(1e6)
        return blocks.withColumn("__s", seconds).withColumn("__d", F.col("__s") - F.lag("__s", 1).over(w)).drop("__s")

    src = df.select(*panel.keys, panel.ts)
    d = over_blocks(src if first is None else first_n(src, panel, first), panel, spacing, back=1)
    counts = d.filter(F.col("__d").isNotNull()).groupBy(*panel.keys, "__d").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*panel.keys).agg(
        F.max_by("__d", F.struct(F.col("n"), -F.col("__d"))).alias("step_seconds"),
        F.max("n").alias("n_steps"),
    )


WEEKDAYS, MONTHS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN"), ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
# Fixed steps by seconds, from the longest on.
FIXED_STEPS = ((86400, "D"), (3600, "h"), (60, "min"), (1, "s"))


def infer_calendar(df: DataFrame, panel: Panel) -> DataFrame:
    """(keys, n_rows, frequency): the name of the step that all of a series' rows keep, null where there is none or under three rows.

    Fixed steps are named by their largest unit (``D``, ``2h``, ``15min``), whole weeks by their weekday (``W-SUN``). Steps of
    the calendar are months (``MS``, ``ME``: first or last day), quarters (``QS-OCT``, ``QE-DEC``: a month they start or end in, the
    last one of the year for ends and the first month of the last quarter for starts), years (``YS-JAN``, ``YE-DEC``), the first or last weekday of a month (``BMS``,
    ``BME``), and weekdays (``B``). Rows need one time of day for these. A repeated time keeps no step.
    """
    ts = F.col(panel.ts)

    def looked(blocks: DataFrame, w) -> DataFrame:
        before = F.lag(panel.ts, 1).over(w)
        gap = (F.unix_micros(ts.cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) / F.lit(1e6)
        months = (F.year(ts) - F.year(before)) * 12 + F.month(ts) - F.month(before)
        weekdays = (gap == 86400) | ((gap == 3 * 86400) & (F.weekday(ts) == 0))
        return blocks.withColumns({"__gap": gap, "__months": months, "__next": weekdays})

    rows = over_blocks(df.select(*panel.keys, panel.ts).filter(ts.isNotNull()), panel, looked, back=1)
    day, last, dow = F.dayofmonth(ts), F.dayofmonth(F.last_day(ts)), F.weekday(ts)
    # The first weekday of a month is day 1, or a Monday on day 2 or 3; the last one likewise.
    first_work = (dow < 5) & ((day == 1) | ((dow == 0) & (day <= 3)))
    last_work = (dow < 5) & ((day == last) | ((dow == 4) & (day >= last - 2)))
    all_of = lambda c: F.min(c.cast("int")) == 1
    seen = rows.groupBy(*panel.keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("__gap").alias("lo"), F.max("__gap").alias("hi"), F.min("__months").alias("mlo"), F.max("__months").alias("mhi"),
        F.count_distinct(F.date_format(ts, "HH:mm:ss.SSSSSS")).alias("times"), F.min(dow).alias("dow"), F.max(F.month(ts)).alias("month"),
        all_of(day == 1).alias("starts"), all_of(day == last).alias("ends"), all_of(first_work).alias("work_starts"), all_of(last_work).alias("work_ends"),
        all_of((dow < 5) & F.coalesce("__next", F.lit(True))).alias("work"))
    name = lambda names, c: F.element_at(F.array(*[F.lit(v) for v in names]), c)
    times = lambda k, unit: F.concat(F.when(k > 1, k.cast("string")).otherwise(""), unit)
    step, months = F.col("lo").cast("bigint"), F.col("mlo")
    fixed = F.when((step % (7 * 86400)) == 0, times(F.floor(step / (7 * 86400)), F.concat(F.lit("W-"), name(WEEKDAYS, F.col("dow") + 1))))
    for seconds, unit in FIXED_STEPS:
        fixed = fixed.when(step % seconds == 0, times(F.floor(step / seconds), F.lit(unit)))
    anchored = lambda side: (
        F.when(months % 12 == 0, times(F.floor(months / 12), F.concat(F.lit(f"Y{side}-"), name(MONTHS, F.col("month")))))
        .when(months % 3 == 0, times(F.floor(months / 3), F.concat(F.lit(f"Q{side}-"), name(MONTHS, F.col("month")))))
        .otherwise(times(months, F.lit(f"M{side}"))))
    regular = (F.col("mlo") == F.col("mhi")) & (F.col("mlo") > 0) & (F.col("times") == 1)
    frequency = (
        F.when((F.col("n_rows") < 3) | (F.col("lo") <= 0), None)
        .when((F.col("lo") == F.col("hi")) & (F.col("lo") == step), fixed)
        .when(regular & F.col("starts"), anchored("S")).when(regular & F.col("ends"), anchored("E"))
        .when(regular & F.col("work_starts"), times(months, F.lit("BMS"))).when(regular & F.col("work_ends"), times(months, F.lit("BME")))
        .when(F.col("work") & (F.col("times") == 1), F.lit("B")))
    return seen.select(*panel.keys, "n_rows", frequency.alias("frequency"))
