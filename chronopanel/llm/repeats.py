"""Removing byte strings that stand in more than one place: a depth-limited radix sort of suffixes.

Suffixes are ordered by their first ``length`` bytes only, by passes over one digit each, and after every pass only
groups of more than one go on. What is left equal after the last pass are exactly the repeated windows.

The digits are chosen so that the first passes handle runs of suffixes at once. Every window of ``length`` bytes
holds one anchor, the least of its grams of ``gram`` bytes by hash, and equal windows hold it at the same place. So

1. the first digit of a suffix is its anchor gram. Windows in a row share an anchor: they are one row, a segment;
2. the second is all the bytes under a segment. Segments equal in it are repeated as a whole;
3. where an anchor stands in segments that differ, windows are taken by blocks of 16 in a row, counted from the anchor.
   The digit is the bytes that all 16 share, and then the bytes under any of them: a block alone in the first
   holds no repeated window, blocks equal in the second hold nothing else;
4. for the blocks that are left, the last digit is the window itself.

Passes are Spark aggregations by hash. A common string is counted before it is dealt out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.llm.decontamination import row_key
from chronopanel.llm.hashing import U64, in_pieces, mix, numbers
from chronopanel.llm.registry import query, table
from chronopanel.session import materialize

LENGTH, GRAM = 400, 128
# Windows to a block. Less than the bytes that a window has besides its anchor.
BLOCK = 16
# A text is read in pieces of so many windows, with the bytes that the last ones need.
PIECE = 1 << 18
PLACE_BITS = 22
# Keys of documents, 16 bytes each, that may be broadcast.
MAX_BROADCAST_ROWS = 100_000


@cache
def _powers(seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value of each byte, powers of a base, powers of its inverse)."""
    base = int(numbers(seed, 4)[3]) | 5
    n = PIECE + (1 << 16)
    up, down = np.full(n, base, U64), np.full(n, pow(base, -1, 1 << 64), U64)
    up[0] = down[0] = 1
    return numbers(seed + 1, 256), np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)


class Rolling:
    """Hashes of any parts of a piece of text."""

    def __init__(self, data: np.ndarray, seed: int) -> None:
        value, up, self.down = _powers(seed)
        self.sums = np.empty(len(data) + 1, U64)
        self.sums[0] = 0
        np.cumsum(value[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the parts between arrays of places."""
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U64))

    def all_of(self, size: int) -> np.ndarray:
        """Of every part of ``size`` bytes."""
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n])


def _sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    size = -(-len(x) // width) * width
    padded = np.full(size, np.iinfo(U64).max, U64)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - width + 1
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def segments(text: bytes, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(gram hash, two hashes of the bytes under the segment, first window, last window, anchor) of each, piece by piece."""
    for at in range(0, max(len(text) - length + 1, 0), PIECE):
        data = np.frombuffer(text, np.uint8, min(PIECE + length - 1, len(text) - at), at)
        one, two = Rolling(data, 21), Rolling(data, 31)
        grams = one.all_of(gram)
        mask = U64((1 << PLACE_BITS) - 1)
        least = _sliding_minimum((grams & ~mask) | np.arange(len(grams), dtype=U64), length - gram + 1)
        place = (least & mask).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        last = np.append(first[1:], len(place)) - 1
        end = last + length
        yield grams[place[first]], one.of(first, end), two.of(first, end), first + at, last + at, place[first] + at


def blocks(data: bytes, anchor: int, length: int) -> tuple[np.ndarray, ...]:
    """Of a segment's bytes and the place of its anchor in them: (hash of what all windows of a block share, two hashes of
    the bytes under the segment's windows of the block, first window, last window) of each block."""
    part = np.frombuffer(data, np.uint8)
    one, two = Rolling(part, 41), Rolling(part, 51)
    windows = len(part) - length + 1
    number = (np.arange(windows) - anchor) // BLOCK
    first = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
    last = np.append(first[1:], windows) - 1
    begin = number[first] * BLOCK + anchor  # of the whole block, which the segment may hold a part of
    return one.of(begin + BLOCK - 1, begin + length), one.of(first, last + length), two.of(first, last + length), first, last


def _signed(parts: list[np.ndarray]) -> pa.Array:
    return pa.array(np.concatenate(parts).astype(np.int64) if parts else np.empty(0, np.int64))


def _with_text(docs: DataFrame, key: list, text_col: str, keys: DataFrame) -> DataFrame:
    """Documents (__k1, __k2, text) whose key is in ``keys``, once per distinct row."""
    few = keys.select("__k1", "__k2").distinct()
    texts = docs.select(*key, F.col(f"`{text_col}`").cast("binary").alias("text"))
    if few.count() <= MAX_BROADCAST_ROWS:
        few = F.broadcast(few)
    return texts.join(few, ["__k1", "__k2"], "left_semi")


def repeated_windows(docs: DataFrame, id_col: str, text_col: str, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(__k1, __k2, first, last): runs of window starts, of windows that also start elsewhere. Runs may overlap."""
    key = row_key(id_col, text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in in_pieces(batches, ["__k1", "__k2"], "text"):
            row, out = [], [[] for _ in range(6)]
            for i, text in enumerate(texts):
                for part in segments(text, length, gram):
                    row.append(np.full(len(part[0]), i))
                    for o, p in zip(out, part, strict=True):
                        o.append(p)
            take = pa.array(np.concatenate(row) if row else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [ids["__k1"].take(take), ids["__k2"].take(take), *map(_signed, out)], names=["__k1", "__k2", "g", "c1", "c2", "first", "last", "anchor"])

    src = docs.filter(F.octet_length(F.col(f"`{text_col}`")) >= length).select(*key, F.col(f"`{text_col}`").cast("binary").alias("text"))
    found = materialize(src.mapInArrow(cut, "__k1 bigint, __k2 bigint, g bigint, c1 bigint, c2 bigint, first bigint, last bigint, anchor bigint"))
    # Pass 1: anchors that stand in one place only hold no repeated window.
    # What is joined on is stored first: Spark splits a large group of a join, but not below an aggregation by the same key.
    often = materialize(found.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("g"))
    live = materialize(found.join(often, "g"))
    # Pass 2: equal segments. One of each stands for all.
    place = ("__k1", "__k2", "first", "last", "anchor")
    groups = materialize(live.groupBy("g", "c1", "c2").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in place]))
    whole = live.join(groups.filter("n > 1").select("g", "c1", "c2"), ["g", "c1", "c2"], "left_semi").select("__k1", "__k2", "first", "last")
    # Anchors with segments that differ, of which one at least is not yet known to be repeated, go on with their bytes.
    unlike = materialize(groups.groupBy("g").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 AND least = 1").select("g"))
    mixed = materialize(groups.join(unlike, "g", "left_semi").select("n", *place))
    per_doc = mixed.groupBy("__k1", "__k2").agg(F.collect_list(F.struct("n", "first", "last", "anchor")).alias("parts"))
    texts = _with_text(docs, key, text_col, mixed).dropDuplicates(["__k1", "__k2"])
    open_segments = materialize(
        texts.join(per_doc, ["__k1", "__k2"]).select("__k1", "__k2", "text", F.explode("parts").alias("p"))
        .select("__k1", "__k2", "p.*", F.substring("text", F.col("p.first").cast("int") + 1, (F.col("p.last") - F.col("p.first")).cast("int") + length).alias("text"))
        .withColumn("anchor", F.col("anchor") - F.col("first")))
    # Pass 3: blocks of windows.
    ids = ["__k1", "__k2", "n", "first"]
    in_blocks = materialize(_expand(open_segments, [*ids, "anchor"], ids, lambda text, row: blocks(text, row["anchor"], length), ("core", "u1", "u2", "lo", "hi")))
    shared = materialize(in_blocks.groupBy("core").agg(F.sum("n").alias("m")).filter("m > 1").select("core"))
    kinds = in_blocks.join(shared, "core", "left_semi").groupBy("core", "u1", "u2").agg(F.sum("n").alias("m"), *[F.first(c).alias(c) for c in (*ids, "lo", "hi")])
    kinds = materialize(kinds)
    run = lambda t: t.select("__k1", "__k2", (F.col("first") + F.col("lo")).alias("first"), (F.col("first") + F.col("hi")).alias("last"))
    # A block that is alone stands for itself; equal ones are looked up again.
    equal = run(in_blocks.filter("n = 1").join(kinds.filter("m > 1").select("core", "u1", "u2"), ["core", "u1", "u2"], "left_semi"))
    unsure = materialize(kinds.groupBy("core").agg(F.count(F.lit(1)).alias("kinds"), F.min("m").alias("least")).filter("kinds > 1 AND least = 1").select("core"))
    # Pass 4: single windows of one block of each kind.
    asked = kinds.join(unsure, "core", "left_semi").groupBy("__k1", "__k2", "n", "first").agg(F.collect_list(F.struct("lo", "hi", "m")).alias("wanted"))
    single = materialize(_expand(open_segments.join(asked, ids), [*ids, "wanted"], ["__k1", "__k2", "first"], lambda text, row: _windows(text, row["wanted"], length), ("w1", "w2", "at", "m")))
    twice = single.groupBy("w1", "w2").agg(F.sum("m").alias("m")).filter("m > 1").select("w1", "w2")
    starts = single.filter("m = 1").join(twice, ["w1", "w2"], "left_semi").select("__k1", "__k2", (F.col("first") + F.col("at")).alias("first"))
    return whole.unionByName(equal).unionByName(starts.withColumn("last", F.col("first")))


def _windows(data: bytes, wanted: list[dict], length: int) -> tuple[np.ndarray, ...]:
    """(two hashes, place, weight) of each single window of some blocks of a segment."""
    part = np.frombuffer(data, np.uint8)
    at = np.concatenate([np.arange(w["lo"], w["hi"] + 1) for w in wanted])
    weight = np.concatenate([np.full(w["hi"] - w["lo"] + 1, w["m"]) for w in wanted])
    return Rolling(part, 61).of(at, at + length), Rolling(part, 71).of(at, at + length), at, weight


def _expand(segments_: DataFrame, read: list[str], keep: list[str], work, names: tuple[str, ...]) -> DataFrame:
    """Rows (``keep``, ``names``) that ``work(bytes, row)`` makes of each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in in_pieces(batches, read, "text"):
            rows = pa.RecordBatch.from_pydict(ids).to_pylist()
            index, out = [], [[] for _ in names]
            for i, (text, row) in enumerate(zip(texts, rows, strict=True)):
                made = work(text, row)
                index.append(np.full(len(made[0]), i))
                for o, m in zip(out, made, strict=True):
                    o.append(m)
            take = pa.array(np.concatenate(index) if index else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([*(ids[c].take(take) for c in keep), *map(_signed, out)], names=[*keep, *names])

    return segments_.select(*read, "text").mapInArrow(run, ", ".join(f"`{c}` bigint" for c in (*keep, *names)))


def _removed(text: bytes, first: np.ndarray, last: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    order = np.argsort(first, kind="stable")
    lo, hi = first[order], np.maximum.accumulate(last[order] + length)
    new = np.flatnonzero(np.concatenate(([True], lo[1:] > hi[:-1])))
    return list(zip(lo[new].tolist(), hi[np.append(new[1:] - 1, len(hi) - 1)].tolist(), strict=True))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """A row per input row: id, n_bytes, n_removed, n_spans (maximal removed runs), spans (start, end), kept (bytes), kept_sha256.

    Every byte goes that lies in a string of ``length`` bytes that also starts elsewhere, in this text or another one.
    Strings are judged on the texts as they come in.

    Null text is empty; texts under ``length`` bytes are kept whole. Rows that are equal, or share an id, are texts of
    their own, so equal rows remove each other. A null id is an id. An empty table gives an empty result. Columns other
    than id and text are not read. ``kept`` may cut a character in two, so it is binary.
    """
    key = row_key(id_col, text_col)
    runs = repeated_windows(docs, id_col, text_col, length, gram)
    per_doc = materialize(runs.groupBy("__k1", "__k2").agg(F.collect_list(F.struct("first", "last")).alias("runs")))
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"), *key)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in in_pieces(batches, ["id", "runs"], "text"):
            spans, kept, sha, gone = [], [], [], []
            for text, value in zip(texts, ids["runs"], strict=True):
                found = []
                if value.is_valid:
                    found = _removed(text, value.values.field("first").to_numpy(), value.values.field("last").to_numpy(), length)
                left, at = [], 0
                for lo, hi in found:
                    left.append(text[at:lo])
                    at = hi
                left.append(text[at:])
                rest = b"".join(left)
                spans.append([{"start": lo, "end": hi} for lo, hi in found])
                kept.append(rest), sha.append(hashlib.sha256(rest).hexdigest()), gone.append(len(text) - len(rest))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [ids["id"], pa.array([len(t) for t in texts], pa.int64()), pa.array(gone, pa.int64()), pa.array([len(s) for s in spans], pa.int64()),
                 pa.array(spans, kind), pa.array(kept, pa.binary()), pa.array(sha, pa.string())],
                names=[id_col, "n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_sha256"])

    schema = (f"`{id_col}` {dict(base.dtypes)['id']}, n_bytes bigint, n_removed bigint, n_spans bigint, "
              "spans array<struct<start: bigint, end: bigint>>, kept binary, kept_sha256 string")
    clean = F.lit(None).cast("array<struct<first: bigint, last: bigint>>").alias("runs")
    columns = ["id", "text", "runs"]
    if per_doc.count() <= MAX_BROADCAST_ROWS:
        # Texts without a repeat need no partner, so they are not dealt out.
        few = F.broadcast(per_doc.select("__k1", "__k2"))
        hit = base.join(few, ["__k1", "__k2"], "left_semi").join(per_doc.hint("merge"), ["__k1", "__k2"]).select(*columns)
        joined = hit.unionByName(base.join(few, ["__k1", "__k2"], "left_anti").select("id", "text", clean))
    else:
        joined = base.join(per_doc, ["__k1", "__k2"], "left").select(*columns)
    return joined.mapInArrow(cut, schema)


@query(
    "op4_suffix_repeats",
    """
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    cut AS (SELECT doc_id, b, h[2 * b + 1:2 * b + 2 * 699] AS p
            FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 399, 300)) AS b FROM d WHERE len(h) >= 800)),
    w AS (SELECT doc_id, b + j AS i, hash(p[2 * j + 1:2 * j + 800]) AS k
          FROM (SELECT doc_id, b, p, unnest(range(0, len(p) // 2 - 399)) AS j FROM cut)),
    hits AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 AS joined
             FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
    runs AS (SELECT doc_id, i, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM hits),
    spans AS (SELECT doc_id, run, min(i) AS lo, max(i) + 400 AS hi FROM runs GROUP BY doc_id, run),
    gone AS (SELECT doc_id, sum(hi - lo) AS n, count(*) AS spans FROM spans GROUP BY doc_id),
    parts AS (
      SELECT doc_id, hi AS lo, lead(lo) OVER (PARTITION BY doc_id ORDER BY lo) AS hi FROM spans
      UNION ALL SELECT d.doc_id, 0, min(lo) FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id),
    kept AS (
      SELECT doc_id, string_agg(h[2 * lo + 1:coalesce(2 * hi, len(h))], '' ORDER BY lo) AS rest
      FROM parts JOIN d USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
           sha256(unhex(coalesce(rest, ''))) AS kept_sha256
    FROM d JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)
    """,
)
def op4_suffix_repeats(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
