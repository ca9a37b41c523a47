"""Mixing sources to target weights.

The words of a source, document after document, are a stream cut into blocks of fixed length.
Every output slot holds one block. How many slots of each output shard go to each source is a
multinomial draw conditioned on the totals that the targets ask for: a pseudorandom order of all
slots is dealt out to the sources. A source's slots then walk through its blocks in a pseudorandom order
of its own for each pass, so no block is taken a second time before all are taken once.

The pseudorandom orders are ranks by a hash, taken in buckets (`prefix_sum`), so that no source is
gathered in one task. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.llm.prefix_sum import buckets_for, running_start
from chronopanel.llm.registry import query, table
from chronopanel.llm.text import word_count
from chronopanel.session import materialize

BLOCK_WORDS = 128
MAX_PASSES = 3
SEED = 20240607


def code_point_order(text):
    """A key that orders strings by code point and nulls last. (UTF-8 bytes order alike.)"""
    return F.when(text.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.hex(text.cast("binary"))))


def cyclic_weights(totals: DataFrame, cycle: int = 3) -> DataFrame:
    """Weights 1, 2, .., ``cycle``, repeating, to the sources in code point order, null last."""
    at = F.row_number().over(Window.orderBy(code_point_order(F.col("__source"))))
    return totals.withColumn("__weight", (F.pmod(at - 1, F.lit(cycle)) + 1).cast("double"))


def targets(weighted: DataFrame, max_passes: int = MAX_PASSES) -> DataFrame:
    """Words to take of each source: its share of all words by weight, at most ``max_passes`` times
    what it has; the excess goes to the others by weight until none is above.

    A source is cut off when the level (words per unit of weight) exceeds its cap per unit of weight. In
    the order of that ratio the cut-off sources come first, so one running sum finds the level. The input
    is a row per source.
    """
    cap, ratio = F.col("__have") * F.lit(max_passes), F.col("__ratio")
    everything = Window.partitionBy()
    order = Window.orderBy(ratio, code_point_order(F.col("__source")))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    src = weighted.withColumn("__ratio", cap / F.col("__weight"))
    src = src.withColumn("__total", F.sum("__have").over(everything)).withColumn(
        "__level",
        (F.col("__total") - F.coalesce(F.sum(cap).over(before), F.lit(0)))
        / (F.sum("__weight").over(everything) - F.coalesce(F.sum("__weight").over(before), F.lit(0.0))),
    )
    src = src.withColumn("__at", F.row_number().over(order)).withColumn("__free", F.col("__level") <= ratio)
    first = F.min(F.when(F.col("__free"), F.struct("__at", "__level"))).over(everything)
    src = src.withColumn("__first", first)
    free, level = F.col("__at") >= F.col("__first.__at"), F.col("__first.__level")
    target = F.when(free, F.least(F.col("__weight") * level, cap.cast("double"))).otherwise(cap.cast("double"))
    return src.withColumn("__target", target).drop("__ratio", "__total", "__level", "__at", "__free", "__first")


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             block_words: int = BLOCK_WORDS, slots_per_shard: int = 4096, max_passes: int = MAX_PASSES,
             seed: int = SEED, weigh=cyclic_weights) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, sources, slots) of a mix; all three are stored tables.

    documents: a row per input row: __id, __source, __size (words), __start (its first word in the stream).
    sources: __source, __have (words), __blocks, __target, __want (the target in whole words), __passes
    (whole passes over all blocks), __rest (words of the last pass).
    slots: a row per output block: __source, pass, block, words (taken of it), shard, slot.

    Each source takes its target in whole words, give or take less than a block: the last slot is cut to
    what is missing, and only the last block of a stream may be shorter than the others.
    """
    base = docs.select(
        F.col(f"`{id_col}`").alias("__id"), F.col(f"`{source_col}`").cast("string").alias("__source"),
        word_count(F.col(f"`{text_col}`")).alias("__size"), F.xxhash64(F.col(f"`{text_col}`")).alias("__h"))
    base = materialize(base)
    n_rows = base.count()
    placed = materialize(running_start(base, ["__source"], [F.col("__id"), F.col("__h")], "__size", buckets_for(n_rows), "__start").drop("__h"))
    totals = placed.groupBy("__source").agg(F.sum("__size").alias("__have"))
    want = F.round("__target").cast("bigint")
    sources = targets(weigh(totals), max_passes).select(
        "__source", "__have", "__target", want.alias("__want"),
        F.ceil(F.col("__have") / F.lit(block_words)).cast("bigint").alias("__blocks"),
        F.when(F.col("__have") > 0, F.least(F.lit(max_passes), F.floor(want / F.col("__have")))).otherwise(0).cast("bigint").alias("__passes"),
    )
    sources = materialize(sources.withColumn(
        "__rest", F.when(F.col("__passes") < max_passes, F.col("__want") - F.col("__passes") * F.col("__have")).otherwise(0)))

    # A row per pass and block. Runs of blocks are exploded twice, so one source spreads over tasks.
    run = 10_000
    size = F.ceil(F.col("__rest") / F.lit(block_words)).cast("bigint")
    spans = (
        sources.filter(F.col("__blocks") > 0)
        .withColumn("lo", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__blocks") - 1, F.lit(run).cast("bigint"))))
        .repartition(F.col("__source"), F.col("lo"))
        .withColumn("block", F.explode(F.sequence(F.col("lo"), F.least(F.col("lo") + run, F.col("__blocks")) - 1)))
        .withColumn("length", F.least(F.lit(block_words), F.col("__have") - F.col("block") * block_words).cast("bigint"))
    )
    whole = spans.filter(F.col("__passes") > 0).withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("__passes").cast("int"))))
    whole = whole.select("__source", "pass", "block", F.col("length").alias("words"))
    # In the last pass the blocks of lowest rank are taken. The rank is the running count in hash order.
    n_blocks = sources.agg(F.sum("__blocks")).first()[0] or 0
    mixed = F.xxhash64(F.lit(seed), F.col("__source"), F.col("block"))
    last = spans.filter(F.col("__rest") > 0).withColumn("one", F.lit(1).cast("bigint"))
    last = running_start(last, ["__source"], [mixed, F.col("block")], "one", buckets_for(n_blocks), "rank").filter(F.col("rank") < size)
    left = F.col("__rest") - F.col("rank") * block_words
    last = last.select("__source", (F.col("__passes") + 1).cast("int").alias("pass"), "block", F.least(F.col("length"), left).alias("words"))
    drawn = materialize(whole.unionByName(last))
    # Which shard a slot is in: the rank of a second hash over all sources. Shards so get what a
    # multinomial draw gives, on the condition that the totals are those wanted.
    n_slots = drawn.count()
    order = F.xxhash64(F.lit(seed + 1), F.col("__source"), F.col("pass"), F.col("block"))
    slots = running_start(drawn.withColumn("one", F.lit(1).cast("bigint")).withColumn("all", F.lit(0)), ["all"],
                          [order, F.col("__source"), F.col("pass"), F.col("block")], "one", buckets_for(n_slots), "at").select(
        "__source", "pass", "block", "words", F.floor(F.col("at") / slots_per_shard).alias("shard"), F.pmod(F.col("at"), F.lit(slots_per_shard)).alias("slot"))
    return placed, sources, materialize(slots)


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                  block_words: int = BLOCK_WORDS, **options) -> DataFrame:
    """A row per input row: id, source, size, source_size, target, taken.

    taken: how many of its words the mix holds, repeats counted.

    A null text has no words, and nothing is taken of it. A null source is a source, the last one.
    Rows that share an id, or are equal, are separate documents in one stream. A source without words has target 0. An
    empty table gives an empty result. Other columns are not read.
    """
    placed, sources, slots = mix_plan(docs, id_col, text_col, source_col, block_words, **options)
    cut = lambda at: F.floor(at / F.lit(block_words))
    end = F.col("__start") + F.col("__size")
    pieces = (
        placed.filter(F.col("__size") > 0)
        .select("__source", "__start", end.alias("__end"), F.explode(F.sequence(cut(F.col("__start")), cut(end - 1))).alias("__block"))
        .select("__source", "__start", "__block",
                F.greatest(F.col("__start") - F.col("__block") * block_words, F.lit(0)).alias("__from"),
                F.least(F.col("__end") - F.col("__block") * block_words, F.lit(block_words)).alias("__to"))
    )
    # Where a piece of a block is wanted: once per slot, as far as the slot goes.
    per_block = slots.select(F.col("__source").alias("__s"), F.col("block").alias("__b"), "words")
    on = F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__block") == F.col("__b"))
    # A document with words is named by its source and where it starts there.
    taken = (
        pieces.join(per_block, on)
        .groupBy(F.col("__source").alias("__s"), F.col("__start").alias("__b"))
        .agg(F.sum(F.greatest(F.least("__to", "words") - F.col("__from"), F.lit(0))).alias("__taken"))
    )
    on = F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__start") == F.col("__b")) & (F.col("__size") > 0)
    of = sources.select(F.col("__source").alias("__o"), "__have", "__target")
    return (
        placed.join(taken, on, "left")
        .join(of, F.col("__source").eqNullSafe(F.col("__o")))
        .select(
            F.col("__id").alias(id_col), F.col("__source").alias(source_col), F.col("__size").alias("size"),
            F.col("__have").alias("source_size"), F.col("__target").alias("target"),
            F.coalesce("__taken", F.lit(0)).cast("bigint").alias("taken"),
        )
    )


def mixed_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` as whole documents in the proportions of the mix: each as often as its words are taken, rounded up or
    down by a hash of the row so that roundings cancel out; all columns are kept. At most ``max_passes`` copies.

    Documents of which nothing is taken, so all without words, go. Equal rows share what is taken of them evenly.
    """
    taken = mix_documents(docs, id_col, text_col, source_col, **options)
    # Rows are told apart by id, source and size; those alike in all three share alike.
    # A hash passes nulls over, so where they are is hashed as well.
    def at(cols: list) -> list:
        nulls = [c.isNull() for c in cols]
        return [F.xxhash64(*nulls, *cols).alias("__k1"), F.xxhash64(F.lit(7), *nulls, *cols[::-1]).alias("__k2")]

    key = [F.col(f"`{id_col}`"), F.col(f"`{source_col}`").cast("string"), F.col("size")]
    share = materialize(taken.select(*at(key), "size", "taken").groupBy("__k1", "__k2").agg((F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).alias("__share")))
    lot = F.pmod(F.xxhash64("__k1", F.lit(SEED)), F.lit(1 << 30)) / (1 << 30)
    copies = share.withColumn("__copies", F.floor(F.col("__share") + lot).cast("int")).filter("__copies > 0").select("__k1", "__k2", "__copies")
    mine = [key[0], key[1], word_count(F.col(f"`{text_col}`"))]
    # The caller's columns travel in a struct, so that none clashes with those in use here.
    return (
        docs.select(F.struct("*").alias("__row"), *at(mine)).join(copies, ["__k1", "__k2"])
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), "__copies"))).select("__row.*")
    )


@query("op9_mixing_sources")
def op9_mixing_sources(spark, sf_dir):
    return mix_documents(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")
