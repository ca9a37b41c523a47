"""Cutting series into bounded units so that one long series spreads over tasks.

A window partitioned by series alone sends each series to one task. Here every
window is partitioned by series *and* a unit:

* ``chunk``: a fixed span of time, enough for work that needs no neighbours or
  whose chunk summaries can be combined afterwards;
* ``block``: a fixed count of consecutive rows, with the last rows of one block
  copied into the next (a halo), so that row lags and row frames are exact.

The summaries that tie units together hold a few rows per unit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from chronopanel.panel import Panel, PanelError
from chronopanel.session import keep

CHUNK, ROW, BLOCK, HALO = "__chunk", "__row", "__block", "__halo"

# A per-series table is broadcast only when a count shows it has no more rows and bytes than this.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def chunk_of(panel: Panel) -> Column:
    """Never null, so that a join on it adds no filter to only one of its sides."""
    chunk = F.floor(panel.seconds() / F.lit(panel.chunk_seconds)).cast("bigint")
    return F.coalesce(chunk, F.lit(-(1 << 62)))


def add_chunk(df: DataFrame, panel: Panel) -> DataFrame:
    return df.withColumn(CHUNK, chunk_of(panel))


def chunk_window(panel: Panel) -> WindowSpec:
    return Window.partitionBy(*panel.keys, CHUNK).orderBy(panel.ts)


def is_stored(df: DataFrame) -> bool:
    """Whether the plan only reads, selects and filters: reading it twice then costs less than keeping branches alike."""
    left = [df._jdf.queryExecution().analyzed()]
    while left:
        node = left.pop()
        # Names of plan nodes, so that no column or folder can look like one.
        if any(word in node.nodeName() for word in ("Aggregate", "Join", "Window", "Generate", "Repartition", "Sort", "Distinct", "Deduplicate")):
            return False
        children = node.children()
        left += [children.apply(i) for i in range(children.size())]
    return True


def row_index(df: DataFrame, panel: Panel, name: str = ROW, spread: bool | None = None) -> DataFrame:
    """Add the 0-based position of each row in its series.

    Position = rows in earlier chunks + position in the own chunk. The chunk
    sizes are a partial aggregate and the running total over them touches one
    row per chunk. On a stored table they read keys and time only. Where a shuffle
    lies upstream (`spread`), they look at every column instead, so that both
    branches ask for the same rows and Spark computes those once.
    """
    spread = not is_stored(df) if spread is None else spread
    src = add_chunk(df, panel)
    columns = [F.col(c) for c, t in df.dtypes if not t.startswith("map")] if spread else [F.col(panel.ts)]
    before = Window.partitionBy(*panel.keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        src.groupBy(*panel.keys, CHUNK)
        .agg(F.count(F.lit(1)).alias("__n"), F.max(F.xxhash64(*columns)).alias("__all"))
        .filter(F.col("__all").isNotNull())
        .select(*panel.keys, CHUNK, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    )
    return (
        src.withColumn("__rn", F.row_number().over(chunk_window(panel)))
        .join(starts, [*panel.keys, CHUNK])
        .withColumn(name, F.col("__start") + F.col("__rn") - 1)
        .drop(CHUNK, "__rn", "__start")
    )


def row_blocks(df: DataFrame, panel: Panel, back: int, ahead: int = 0, indexed: bool = False) -> DataFrame:
    """Assign rows to blocks, repeating rows near a block edge as halo rows.

    A block sees ``back`` rows before and ``ahead`` rows after its own. With
    ``indexed`` the frame already carries a position column from `row_index`.
    """
    if back < 0 or ahead < 0:
        raise PanelError("halo sizes must not be negative")
    size = max(panel.unit_rows, back, ahead, 1)
    src = df if indexed else row_index(df, panel)
    block = F.floor(F.col(ROW) / F.lit(size)).cast("bigint")
    offset = F.col(ROW) % F.lit(size)
    place = lambda shift, halo: F.struct((block + shift).alias("b"), F.lit(halo).alias("h"))
    places = [place(0, False)]
    if back:
        places.append(F.when(offset >= size - back, place(1, True)))
    if ahead:
        places.append(F.when((offset < ahead) & (block > 0), place(-1, True)))
    at = F.explode(F.array_compact(F.array(*places))) if len(places) > 1 else places[0]
    return (
        src.withColumn("__at", at)
        .withColumn(BLOCK, F.col("__at.b"))
        .withColumn(HALO, F.col("__at.h"))
        .drop("__at")
    )


def block_window(panel: Panel) -> WindowSpec:
    return Window.partitionBy(*panel.keys, BLOCK).orderBy(ROW)


def over_blocks(
    df: DataFrame,
    panel: Panel,
    work: Callable[[DataFrame, WindowSpec], DataFrame],
    back: int,
    ahead: int = 0,
    keep_row: bool = False,
    indexed: bool = False,
) -> DataFrame:
    """Run ``work(blocks, window)`` on row blocks and return the own rows only."""
    blocks = row_blocks(df, panel, back, ahead, indexed)
    out = work(blocks, block_window(panel)).filter(~F.col(HALO)).drop(BLOCK, HALO)
    return out if keep_row else out.drop(ROW)


def over_spans(
    df: DataFrame,
    panel: Panel,
    work: Callable[[DataFrame, WindowSpec], DataFrame],
    back_seconds: int,
) -> DataFrame:
    """Like `over_blocks` for frames measured in time: one exchange, no row positions.

    The window is ordered by whole seconds, for use with ``rangeBetween``.
    """
    span = max(panel.chunk_seconds, back_seconds)
    sec = "__sec"
    src = df.withColumn(sec, panel.seconds())
    block = F.floor(F.col(sec) / F.lit(span)).cast("bigint")
    place = lambda shift, halo: F.struct((block + shift).alias("b"), F.lit(halo).alias("h"))
    near_end = F.pmod(F.col(sec), F.lit(span)) >= span - back_seconds
    src = (
        src.withColumn("__at", F.explode(F.array_compact(F.array(place(0, False), F.when(near_end, place(1, True))))))
        .withColumn(BLOCK, F.col("__at.b"))
        .withColumn(HALO, F.col("__at.h"))
        .drop("__at")
    )
    w = Window.partitionBy(*panel.keys, BLOCK).orderBy(sec)
    return work(src, w).filter(~F.col(HALO)).drop(BLOCK, HALO, sec)


def broadcast_if_small(table: DataFrame) -> DataFrame | None:
    """The table marked for broadcast when a count of rows and bytes shows it is small, else None.

    It is computed once and kept, so the check costs no second run.
    """
    table = keep(table)
    # As text a row takes no fewer bytes than in memory, give or take short numbers.
    size = table.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("b")).first()
    return F.broadcast(table) if size["n"] <= BROADCAST_ROWS and (size["b"] or 0) <= BROADCAST_BYTES else None


def small_join(df: DataFrame, table: DataFrame, on: list[str], how: str = "inner",
               fallback: Callable[[], DataFrame] | None = None) -> DataFrame:
    """Join a table that is usually small: broadcast if counted small, else the fallback."""
    small = broadcast_if_small(table)
    if small is not None:
        return df.join(small, on, how)
    return fallback() if fallback else df.join(table, on, how)


def attach(df: DataFrame, panel: Panel, stats: DataFrame) -> DataFrame:
    """Add per-series statistics to every row without gathering a series.

    Beyond the broadcast bound the statistics are repeated per (series, chunk)
    and joined on both, so a series with most of the rows still spreads.
    """
    keys = list(panel.keys)

    def by_chunk() -> DataFrame:
        src = add_chunk(df, panel)
        per_chunk = src.select(*keys, CHUNK).distinct().join(stats, keys)
        return src.join(per_chunk, [*keys, CHUNK]).drop(CHUNK)

    return small_join(df, stats, keys, fallback=by_chunk)
