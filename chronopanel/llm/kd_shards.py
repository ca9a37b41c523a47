"""Sharding by k-d tree partitioning.

The tree splits a node of k shards at the weighted quantile floor(k/2)/k along the dimension in which the
node is widest, until every node is one shard. Weights are bytes, so shards hold nearly equal bytes.

Rows are first added up to cells, one per distinct text, so copies stay together and a large group of
them is small before anything is dealt out; a group that weighs too much for a shard is cut into pieces.
A weighted median is found by radix selection: a cell's position along a dimension is a whole number, and
each pass adds up the weights by the next ten bits of it, within what the last pass has left. A pass
is one partial aggregation over all open nodes. The driver gets one row per node.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.llm.prefix_sum import buckets_for, running_start
from chronopanel.llm.registry import query, table
from chronopanel.llm.text import utf8_size
from chronopanel.session import materialize

# A position: 22 bits of value, 26 of text hash, 12 of piece. The last two settle ties.
VALUE_BITS, HASH_BITS, PIECE_BITS, DIGIT_BITS = 22, 26, 12, 10
POSITION_BITS = VALUE_BITS + HASH_BITS + PIECE_BITS
# The tree is a joined table of at most this many rows, so that it may be broadcast.
MAX_SHARDS = 65_536


@dataclass
class Node:
    """Shards ``first`` to ``first + shards - 1``."""

    first: int
    shards: int


def _values(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A small table out of literals; nothing but the JVM runs for it."""
    names = [x.split()[0] for x in schema.split(",")]
    if not rows:
        return spark.range(0).select(*[F.lit(0).cast("bigint").alias(n) for n in names])
    body = ", ".join("(" + ", ".join(f"{int(v)}L" for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(names)})")


def make_cells(rows: DataFrame, dims: list[str], shard_bytes: float) -> tuple[DataFrame, DataFrame]:
    """(cells, heavy groups). ``rows`` has __h, __weight, __piece_of (spreads a group's rows) and the dims.

    A group over 1/64 of a shard is cut into pieces; there are at most 64 such groups per shard.
    """
    limit = max(1, int(shard_bytes / 64))
    heavy = (
        rows.groupBy("__h").agg(F.sum("__weight").alias("w"), F.count(F.lit(1)).alias("n"))
        .filter((F.col("w") > limit) & (F.col("n") > 1))
        .select(F.col("__h").alias("__heavy"), F.least(F.ceil(F.col("w") / limit), F.col("n"), F.lit(1 << PIECE_BITS)).cast("int").alias("__pieces"))
    )
    heavy = materialize(heavy)
    cells = with_piece(rows, heavy).groupBy("__h", "__piece").agg(
        F.sum("__weight").alias("__weight"), *[F.min(d).alias(d) for d in dims])
    return cells, heavy


def with_piece(rows: DataFrame, heavy: DataFrame) -> DataFrame:
    piece = F.when(F.col("__pieces").isNull(), 0).otherwise(F.pmod(F.col("__piece_of"), F.col("__pieces"))).cast("int")
    return rows.join(F.broadcast(heavy), F.col("__h") == F.col("__heavy"), "left").withColumn("__piece", piece).drop("__heavy", "__pieces")


def _position(value: Column, low: Column, high: Column) -> Column:
    """Whole number of POSITION_BITS bits: the value's place between its extremes, then text hash, then piece."""
    top = (1 << VALUE_BITS) - 1
    share = F.when(high > low, (value - low) / (high - low)).otherwise(0.0)
    coarse = F.floor(F.coalesce(share, F.lit(0.0)) * top).cast("bigint")
    tie = F.shiftrightunsigned(F.col("__h"), 64 - HASH_BITS)
    return F.shiftleft(coarse, HASH_BITS + PIECE_BITS) + F.shiftleft(tie, PIECE_BITS) + F.col("__piece")


def grow_tree(cells: DataFrame, dims: list[str], n_shards: int, shard_bytes: float) -> DataFrame:
    """``cells`` (__h, __piece, __weight, positions named by ``dims``) with a column __shard."""
    spark = cells.sparkSession
    if n_shards > MAX_SHARDS:
        raise ValueError(f"at most {MAX_SHARDS} shards in one tree; shard a coarser partition first")
    tolerance = shard_bytes / 2000
    nodes = [Node(0, n_shards)]
    now = cells.withColumn("__shard", F.lit(0).cast("bigint"))
    while any(n.shards > 1 for n in nodes):
        wide = [n for n in nodes if n.shards > 1]
        extent = {
            r["__shard"]: r for r in now.groupBy("__shard").agg(
                F.sum("__weight").alias("w"), *[f(d).alias(f"{d}_{k}") for d in dims for k, f in (("lo", F.min), ("hi", F.max))]).collect()
        }
        # An empty node keeps its shard numbers, and all of them but the first stay empty.
        open_nodes, state = {}, {}
        for n in wide:
            if (e := extent.get(n.first)) is not None:
                axis = max(range(len(dims)), key=lambda i: (e[f"{dims[i]}_hi"] - e[f"{dims[i]}_lo"], -i))
                open_nodes[n.first] = axis
                left = n.shards // 2
                # (weight wanted on the left, weight known to be left, prefix, bits open)
                state[n.first] = [e["w"] * left / n.shards, 0.0, 0, POSITION_BITS]
        cuts: dict[int, int] = {}
        while state:
            rows = [(first, open_nodes[first], s[2], s[3]) for first, s in state.items()]
            asked = _values(spark, rows, "node bigint, axis bigint, prefix bigint, bits bigint")
            at = F.element_at(F.array(*[F.col(d) for d in dims]), (F.col("axis") + 1).cast("int"))
            digit = F.expr(f"shiftright(__at, cast(bits - {DIGIT_BITS} AS int))")
            sums = (
                now.join(F.broadcast(asked), F.col("__shard") == F.col("node"))
                .withColumn("__at", at)
                .filter(F.expr("bits >= 60 OR shiftright(__at, cast(bits AS int)) = prefix"))
                .groupBy("node", digit.alias("digit"))
                .agg(F.sum("__weight").cast("double").alias("w"))
            )
            known = _values(spark, [(f, int(s[0]), int(s[1])) for f, s in state.items()], "n bigint, want bigint, left bigint")
            run = Window.partitionBy("node").orderBy("digit")
            # The first digit with which the wanted weight is reached; at most 1024 digits a node.
            found = (
                sums.join(F.broadcast(known), F.col("node") == F.col("n"))
                .withColumn("upto", F.col("left") + F.sum("w").over(run))
                .withColumn("last", F.lead("digit").over(run).isNull())
                .filter((F.col("upto") >= F.col("want")) | F.col("last"))
                .groupBy("node")
                .agg(F.min(F.struct("digit", "w", "upto")).alias("x"))
                .select("node", "x.*")
                .collect()
            )
            after = {}
            for r in found:
                want, _, _, bits = state[r["node"]]
                bits -= DIGIT_BITS
                below = r["upto"] - r["w"]
                if r["w"] <= tolerance or bits == 0:
                    right = want - below <= r["upto"] - want  # cut at the nearer edge
                    cuts[r["node"]] = (r["digit"] if right else r["digit"] + 1) << bits
                else:
                    after[r["node"]] = [want, below, r["digit"], bits]
            state = after
        splits, nodes_next = [], []
        for n in nodes:
            left = n.shards // 2
            if n.shards == 1:
                nodes_next.append(n)
                continue
            nodes_next += [Node(n.first, left), Node(n.first + left, n.shards - left)]
            if n.first in cuts:
                splits.append((n.first, open_nodes[n.first], cuts[n.first], n.first + left))
        nodes = nodes_next
        table_ = _values(spark, splits, "node bigint, axis bigint, cut bigint, right bigint")
        at = F.element_at(F.array(*[F.col(d) for d in dims]), (F.col("axis") + 1).cast("int"))
        now = materialize(
            now.join(F.broadcast(table_), F.col("__shard") == F.col("node"), "left")
            .withColumn("__shard", F.when(F.col("node").isNotNull() & (at >= F.col("cut")), F.col("right")).otherwise(F.col("__shard")))
            .drop("node", "axis", "cut", "right")
        )
    return now


def kd_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dims: dict[str, Column] | None = None,
              n_shards: int | None = None, target_bytes: int | None = None, overhead: int = 16) -> DataFrame:
    """One row per input row: id, size, text_crc32, shard, slot (gapless from 0 within its shard).

    ``dims`` are numeric expressions over the columns of ``docs`` (default: logarithm of the text size, id if
    it is a number, CRC of the source if there is one). Size is the text's UTF-8 bytes plus ``overhead``. Give
    ``n_shards``, or ``target_bytes`` for as many shards as bring a shard to that size.

    Equal texts are kept in one shard, except that a group over 1/64 of a shard is cut into pieces, and that one
    group may straddle each split. A shard's bytes differ from the mean by about the size of a large document.

    Null text: 0 bytes and CRC 0, equal to other nulls. Null or NaN in a dimension: its lowest value.
    Rows that share an id or are equal get slots of their own. An empty table gives an empty result. With
    more shards than rows some stay empty. The result's columns are only those named here.
    """
    text = F.col(f"`{text_col}`")
    kinds = dict(docs.dtypes)
    if dims is None:
        dims = {"bytes": F.log1p(utf8_size(text).cast("double"))}
        if kinds[id_col] in ("bigint", "int", "smallint", "tinyint", "double", "float"):
            dims["id"] = F.col(f"`{id_col}`").cast("double")
        if "source" in kinds:
            dims["source"] = F.crc32(F.col("source").cast("string").cast("binary")).cast("double")
    names = [f"__d{i}" for i in range(len(dims))]
    rows = materialize(docs.select(
        F.col(f"`{id_col}`").alias("__id"), (utf8_size(text) + overhead).alias("__weight"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("bigint").alias("__crc"), F.xxhash64(text).alias("__h"),
        F.xxhash64(F.col(f"`{id_col}`")).alias("__piece_of"), *[F.nanvl(d.cast("double"), F.lit(None).cast("double")).alias(n) for n, d in zip(names, dims.values(), strict=True)],
    ))
    total = rows.agg(F.sum("__weight").alias("w"), F.count(F.lit(1)).alias("n"),
                     *[f(n).alias(f"{n}_{k}") for n in names for k, f in (("lo", F.min), ("hi", F.max))]).first()
    if n_shards is None:
        if not target_bytes:
            raise ValueError("give n_shards or target_bytes")
        n_shards = max(1, -(-int(total["w"] or 0) // target_bytes))
    shard_bytes = (total["w"] or 0) / n_shards
    cells, heavy = make_cells(rows, names, shard_bytes)
    literal = lambda x: F.lit(None if x is None else float(x)).cast("double")
    positions = [_position(F.col(n), literal(total[f"{n}_lo"]), literal(total[f"{n}_hi"])).alias(n) for n in names]
    cells = materialize(cells.select("__h", "__piece", "__weight", *positions))
    shards = grow_tree(cells, names, n_shards, shard_bytes).select(F.col("__h").alias("__ch"), F.col("__piece").alias("__cp"), "__shard")
    placed = with_piece(rows, heavy).join(shards, (F.col("__h") == F.col("__ch")) & (F.col("__piece") == F.col("__cp")))
    placed = placed.select("__id", "__weight", "__crc", "__shard", "__h", F.lit(1).cast("bigint").alias("one"))
    slotted = running_start(placed, ["__shard"], [F.col("__id"), F.col("__h")], "one", buckets_for((total["n"] or 0) // n_shards), "slot")
    return slotted.select(F.col("__id").alias(id_col), F.col("__weight").alias("size"), F.col("__crc").alias("text_crc32"),
                          F.col("__shard").cast("int").alias("shard"), F.col("slot").cast("bigint"))


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write ``docs`` as Parquet, a folder per shard, rows in slot order. Ids must be unique."""
    at = assigned.select(F.col(id_col).alias("__id"), "shard", "slot")
    (docs.join(at, docs[id_col].eqNullSafe(F.col("__id"))).drop("__id")
     .repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path))


@query("op8_kd_shards")
def op8_kd_shards(spark, sf_dir):
    out = kd_shards(table(spark, sf_dir, "documents"), n_shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
