"""Benchmark decontamination by a prefix-filtered set join.

Every window of an item (a run of its words) is a set of short shingles that must all be found in a document that
holds the window. So the rarest of them, counted over all documents, is the only prefix that has to be joined:
where a document holds it, the window can only begin at one place. Candidates that do not fit into the document
(length bound) or of which the next necessary shingles stand elsewhere (positional bound) go, and the rest are
verified shingle by shingle over the whole window.

Items are the query set: they are taken in blocks of a bounded number of windows, and all documents are compared
with each block. A block is what is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.llm.hashing import ALNUM, gram_hashes, in_pieces, word_hashes
from chronopanel.llm.registry import query, table
from chronopanel.session import materialize

SHINGLE = 3
# Windows that are broadcast at once; a window of 10 words takes 8 shingle numbers.
BLOCK_WINDOWS = 200_000
# Keys of documents, 16 bytes each, that may be broadcast.
MAX_BROADCAST_ROWS = 100_000


def row_key(id_col, text_col) -> list:
    """128 bits that stand for a row; equal rows share them. A hash passes nulls over, so where they are is hashed as well."""
    i, t = F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`")
    nulls = F.when(i.isNull(), 2).otherwise(0) + F.when(t.isNull(), 1).otherwise(0)
    return [F.xxhash64(nulls, i, t).alias("__k1"), F.xxhash64(nulls, t, i).alias("__k2")]


def item_windows(items: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """Distinct windows: __grams (hashes of their shingles, in order), __words (length), __n (shingle length), __items."""
    src = items.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{text_col}`").cast("binary").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in in_pieces(batches, ["item"], "text"):
            names, grams, lengths, ns = [], [], [], []
            for name, words in zip(ids["item"].to_pylist(), word_hashes(texts, ALNUM), strict=True):
                if not len(words):
                    continue
                size = min(window, len(words))
                n = min(SHINGLE, size)
                all_grams = gram_hashes(words, n).astype(np.int64)
                for at in range(len(words) - size + 1):
                    names.append(name)
                    grams.append(all_grams[at : at + size - n + 1])
                    lengths.append(size)
                    ns.append(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(grams, pa.list_(pa.int64())), pa.array(lengths, pa.int32()), pa.array(ns, pa.int32())],
                names=["item", "__grams", "__words", "__n"])

    found = src.mapInArrow(cut, "item string, __grams array<bigint>, __words int, __n int")
    return found.groupBy("__grams", "__words", "__n").agg(F.collect_set("item").alias("__items"))


class Block:
    """The windows of one block, as arrays that tasks can search."""

    def __init__(self, rows: list):
        self.by_n = {}
        self.windows = [(r["__n"], r["__words"], np.asarray(r["__grams"], np.int64), r["__items"]) for r in rows]
        for n in sorted({w[0] for w in self.windows}):
            self.by_n[n] = np.unique(np.concatenate([w[2] for w in self.windows if w[0] == n]))

    def prefixes(self, counts: dict[tuple[int, int], int]) -> dict[tuple[int, int], list[tuple[int, int, int]]]:
        """(n, gram) -> [(window, place of the gram in it, place of its next rarest gram)]; by each window's rarest gram."""
        out: dict = {}
        for i, (n, _, grams, _) in enumerate(self.windows):
            rare = sorted(range(len(grams)), key=lambda j: (counts.get((n, int(grams[j])), 0), j))
            if counts.get((n, int(grams[rare[0]])), 0):
                out.setdefault((n, int(grams[rare[0]])), []).append((i, rare[0], rare[min(1, len(rare) - 1)]))
        return out


def _matches(spark, docs: DataFrame, text_col: str, key: list, block: Block, all_rows: bool) -> DataFrame:
    """Per document: __k1, __k2, n_words, and where it holds a gram of the block: ns, places, grams."""
    shared = spark.sparkContext.broadcast(block.by_n)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_n = shared.value
        for ids, texts in in_pieces(batches, ["__k1", "__k2"], "text"):
            keep, sizes, ns, places, grams = [], [], [], [], []
            for row, words in enumerate(word_hashes(texts, ALNUM)):
                found = []
                for n, known in by_n.items():
                    g = gram_hashes(words, n).astype(np.int64)
                    at = np.minimum(np.searchsorted(known, g), len(known) - 1)
                    hit = np.flatnonzero(known[at] == g)
                    if len(hit):
                        found.append((np.full(len(hit), n, np.int32), hit.astype(np.int32), g[hit]))
                if all_rows or found:
                    keep.append(row)
                    sizes.append(len(words))
                    for out, k, kind in ((ns, 0, np.int32), (places, 1, np.int32), (grams, 2, np.int64)):
                        out.append(np.concatenate([f[k] for f in found]) if found else np.empty(0, kind))
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids["__k1"].take(take), ids["__k2"].take(take), pa.array(sizes, pa.int64()), pa.array(ns, pa.list_(pa.int32())),
                 pa.array(places, pa.list_(pa.int32())), pa.array(grams, pa.list_(pa.int64()))],
                names=["__k1", "__k2", "n_words", "ns", "places", "grams"])

    schema = "__k1 bigint, __k2 bigint, n_words bigint, ns array<int>, places array<int>, grams array<bigint>"
    return docs.select(*key, F.col(f"`{text_col}`").cast("binary").alias("text")).mapInArrow(scan, schema)


def _verified(spark, matches: DataFrame, block: Block, prefixes: dict) -> DataFrame:
    """Per document with a hit: __k1, __k2, starts and ends of runs of hit words, items."""
    shared = spark.sparkContext.broadcast((block.windows, prefixes))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, first = shared.value
        for batch in batches:
            keep, starts, ends, items = [], [], [], []
            size = batch.column("n_words").to_numpy()
            for row in range(len(batch)):
                n_of = batch.column("ns")[row].values.to_numpy()
                place = batch.column("places")[row].values.to_numpy()
                gram = batch.column("grams")[row].values.to_numpy()
                runs, names = [], set()
                for n in np.unique(n_of):
                    mine = n_of == n
                    at, g = place[mine], gram[mine]  # places ascend
                    for value in np.unique(g):
                        here = at[g == value]
                        for w, offset, second in first.get((int(n), int(value)), ()):
                            _, length, wanted, of = windows[w]
                            begin = here - offset
                            begin = begin[(begin >= 0) & (begin + length <= size[row])]  # length bound
                            for j in dict.fromkeys((second, *range(len(wanted)))):
                                if not len(begin):
                                    break
                                k = np.minimum(np.searchsorted(at, begin + j), len(at) - 1)
                                begin = begin[(at[k] == begin + j) & (g[k] == wanted[j])]
                            if len(begin):
                                names.update(of)
                                runs.append((begin, begin + length))
                if runs:
                    lo = np.concatenate([r[0] for r in runs])
                    hi = np.concatenate([r[1] for r in runs])
                    order = np.argsort(lo, kind="stable")
                    lo, hi = lo[order], np.maximum.accumulate(hi[order])
                    new = np.flatnonzero(np.concatenate(([True], lo[1:] > hi[:-1])))
                    keep.append(row)
                    starts.append(lo[new])
                    ends.append(hi[np.append(new[1:] - 1, len(hi) - 1)])
                    items.append(sorted(names))
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("__k1").take(take), batch.column("__k2").take(take), pa.array(starts, pa.list_(pa.int32())),
                 pa.array(ends, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))],
                names=["__k1", "__k2", "starts", "ends", "items"])

    schema = "__k1 bigint, __k2 bigint, starts array<int>, ends array<int>, items array<string>"
    return matches.filter(F.size("grams") > 0).mapInArrow(verify, schema)


def _find_hits(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id: str, item_text: str, window: int,
               block_windows: int) -> tuple[DataFrame, DataFrame]:
    """Per distinct row: (__k1, __k2, n_words) of all, and (.., runs, items, n_hit) of those with a hit."""
    spark = docs.sparkSession
    key = row_key(id_col, text_col)
    windows = materialize(item_windows(items, window, item_id, item_text))
    n_blocks = max(1, -(-windows.count() // block_windows))
    of_block = F.pmod(F.xxhash64("__grams", "__words"), F.lit(n_blocks))
    totals, hits = None, None
    for b in range(n_blocks):
        block = Block(windows.filter(of_block == b).collect())
        matches = materialize(_matches(spark, docs, text_col, key, block, all_rows=b == 0))
        if totals is None:
            totals = matches.select("__k1", "__k2", "n_words").distinct()
        found = matches.select(F.explode(F.arrays_zip("ns", "grams")).alias("x")).groupBy("x.ns", "x.grams").count().collect()
        prefixes = block.prefixes({(r["ns"], r["grams"]): r["count"] for r in found})
        part = _verified(spark, matches, block, prefixes)
        hits = part if hits is None else hits.unionByName(part)
    runs = F.array_sort(F.flatten(F.collect_list(F.transform(F.arrays_zip("starts", "ends"), lambda x: F.struct(x["starts"].alias("start"), x["ends"].alias("end"))))))
    # Equal rows give equal runs, and runs of different blocks may overlap: what lies before the furthest end so far counts once.
    fresh = F.aggregate(
        "runs", F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda a, x: F.struct((a["n"] + F.greatest(x["end"] - F.greatest(x["start"], a["to"]), F.lit(0))).alias("n"), F.greatest(a["to"], x["end"]).alias("to")))["n"]
    per_doc = (
        hits.groupBy("__k1", "__k2").agg(F.array_distinct(runs).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        .withColumn("n_hit", fresh.cast("bigint")))
    return totals, materialize(per_doc)


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = 10, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """A row per input row: id, n_words, n_hit (words inside an occurrence of a window), items (sorted strings), hits
    (runs of hit words: start, end).

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window.

    Null and empty texts have no words and no hits. Items without words match nothing; a null item id is "".
    Repeated items count once. Rows that share an id are compared one by one. Without items nothing is hit;
    an empty table gives an empty result. Columns other than id and text are not read.
    """
    totals, per_doc = _find_hits(docs, items, id_col, text_col, item_id, item_text, window, block_windows)
    base = docs.select(F.col(f"`{id_col}`").alias(id_col), *row_key(id_col, text_col))
    return base.join(totals, ["__k1", "__k2"]).join(per_doc, ["__k1", "__k2"], "left").select(
        id_col, "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("runs").alias("hits"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
                      item_text: str = "text", window: int = 10, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows of ``docs`` that hold no window of an item, all columns kept. Cases are settled as in `contamination`."""
    _, per_doc = _find_hits(docs, items, id_col, text_col, item_id, item_text, window, block_windows)
    gone = per_doc.select("__k1", "__k2")
    gone = F.broadcast(gone) if gone.count() <= MAX_BROADCAST_ROWS else gone
    # The caller's columns travel in a struct, so that none clashes with those in use here.
    return docs.select(F.struct("*").alias("__row"), *row_key(id_col, text_col)).join(gone, ["__k1", "__k2"], "left_anti").select("__row.*")


@query(
    "op10_decontamination",
    r"""
    WITH dw AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    iw AS (
      SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    windows AS (
      SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
      FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT size FROM windows),
    placed AS (
      SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
      FROM (SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM dw CROSS JOIN sizes WHERE len(w) >= size)),
    hits AS (SELECT doc_id, item_id, i, size FROM placed JOIN windows USING (size, win)),
    words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
    found AS (
      SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(found.n, 0)::BIGINT AS n_items,
           sha256(coalesce(names, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
    FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
    """,
)
def op10_decontamination(spark, sf_dir):
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                      F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
