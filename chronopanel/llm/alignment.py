"""Alignment of two tokenizers on exact-text distinct documents.

Texts are shuffled whole, so that each distinct text is tokenised by both vocabularies and aligned once, however many
documents hold it. Byte offsets where a token ends on both sides cut the text into groups. How often an id of one side
ends with an id of the other is counted over the corpus, each text's pairs weighted by its number of documents, and
what a text's links amount to under these counts is joined to the documents by a key of the text.

Vocabularies are files that Spark reads and sends to the tasks; nothing is opened by path there.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.llm.hashing import PIECE_BYTES
from chronopanel.llm.registry import query, table
from chronopanel.llm.text import text_key
from chronopanel.session import materialize, new_folder

TOKENIZERS = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
# Distinct id pairs (12 bytes each) that may be broadcast; beyond, they are joined by a shuffle.
MAX_BROADCAST_PAIRS = 1_000_000
# Texts of at least this share of all documents are joined apart from the others. There are at most as many as this says.
HOT_SHARE = 1000
MAX_BROADCAST_BYTES = 32 << 20

# Fixed value: the pattern by which byte-level vocabularies of this kind part a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SCHEMA = "k1 bigint, k2 bigint, docs bigint, n_a bigint, n_b bigint, groups string, pairs array<bigint>, times array<bigint>"


def byte_of_symbol() -> dict[str, int]:
    """What the symbols of a byte-level vocabulary stand for: printable Latin-1 bytes themselves, the others from U+0100 on in order."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


def _names(n: int, mark: str) -> tuple[np.ndarray, int]:
    """Each id's decimal digits as a row of bytes, 0 where it has fewer, and the byte that follows a side's last id."""
    return np.array([str(i) for i in range(n)], f"S{len(str(n))}").view(np.uint8).reshape(n, -1), ord(mark)


class ByteLevel:
    """A byte-level BPE; special tokens' strings are plain text. Its entries are in the order of merges, so ids are ranks."""

    def __init__(self, data: bytes) -> None:
        import tiktoken

        symbols, file = byte_of_symbol(), json.loads(data)
        special = {t["content"] for t in file["added_tokens"]}
        ranks = {bytes(symbols[c] for c in entry): i for entry, i in file["model"]["vocab"].items() if entry not in special}
        self.model = tiktoken.Encoding("byte level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for entry, i in ranks.items():
            self.bytes[i] = entry
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.names = _names(len(self.bytes), "|")

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.model.encode_ordinary(" " + t) for t in texts]


class Pieces:
    """A piece vocabulary with byte fallback; it puts the space in front by itself."""

    def __init__(self, data: bytes) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.names = _names(len(self.bytes), ";")

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def align(a: list[int], b: list[int], size_a: np.ndarray, size_b: np.ndarray, names_a: tuple, names_b: tuple) -> tuple[str, np.ndarray, np.ndarray]:
    """Groups as text (``a1,a2|b1;a3|b2``), and the ids on both sides of each link, of one text's tokens."""
    (digits_a, mark_a), (digits_b, mark_b) = names_a, names_b
    a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
    end_a, end_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
    ends = np.zeros((2, max(end_a[-1] if len(a) else 0, end_b[-1] if len(b) else 0) + 1), bool)
    ends[0, end_a], ends[1, end_b] = True, True
    cut = np.flatnonzero(ends[0] & ends[1])
    # Tokens that end at a cut: one of each side, but runs of them where a token has no bytes.
    plain = size_a[a].all() and size_b[b].all()
    if plain:
        first_a, first_b = np.flatnonzero(ends[1][end_a]), np.flatnonzero(ends[0][end_b])
        last_a, last_b = first_a + 1, first_b + 1
    else:
        first_a, first_b = np.searchsorted(end_a, cut), np.searchsorted(end_b, cut)
        last_a, last_b = np.searchsorted(end_a, cut, side="right"), np.searchsorted(end_b, cut, side="right")
    # Each id's place in the text: behind all of its own side before it, and of the other side in earlier groups, or also its own.
    before_b = np.repeat(np.concatenate(([0], last_b[:-1])), np.diff(last_a, prepend=0)) if len(cut) else last_a
    before_a = np.repeat(last_a, np.diff(last_b, prepend=0))
    at_a, at_b = np.arange(len(before_b)) + before_b, np.arange(len(before_a)) + before_a
    # A row of bytes for each id, the last one for what follows it; zeros are left out.
    text = np.zeros((len(at_a) + len(at_b), max(digits_a.shape[1], digits_b.shape[1]) + 1), np.uint8)
    text[at_a, : digits_a.shape[1]], text[at_b, : digits_b.shape[1]] = digits_a[a[: len(at_a)]], digits_b[b[: len(at_b)]]
    text[:, -1] = ord(",")
    text[at_a[last_a - 1], -1], text[at_b[last_b - 1], -1] = mark_a, mark_b
    shown = text[text != 0].tobytes()[:-1].decode()
    if not plain and len(cut):
        links = [(x, y) for k in range(len(cut)) for x in a[first_a[k] : last_a[k]] for y in b[first_b[k] : last_b[k]]]
        left, right = np.array([x for x, _ in links], np.int64), np.array([y for _, y in links], np.int64)
    else:
        left, right = a[first_a], b[first_b]
    return shown, left, right


def _files(spark: SparkSession, folder: str, names: tuple[str, str]) -> list[bytes]:
    """The vocabulary files, read by Spark on the driver; some megabytes."""
    found = spark.read.format("binaryFile").load([f"{folder.rstrip('/')}/{n}" for n in names]).select("path", "content").collect()
    by_name = {r["path"].rsplit("/", 1)[-1]: bytes(r["content"]) for r in found}
    return [by_name[n] for n in names]


def aligned_texts(docs: DataFrame, text_col: str = "text", folder: str = TOKENIZERS, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """A row per distinct text that both sides spell out byte by byte: k1 and k2 (128 bits that stand for the text), docs (its
    number of rows), n_a, n_b, groups (as in `align`), pairs and times (its distinct linked id pairs, a << 32 | b, and how often).

    Null and empty texts, and those that a side does not spell out as a space and the text, have no row.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(_files(spark, folder, (a_file, b_file)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data_a, data_b = sent.value
        one, two = ByteLevel(data_a), Pieces(data_b)
        for batch in batches:
            texts, at = batch.column("text").to_pylist(), 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= PIECE_BYTES // 4):
                    size += len(texts[to])
                    to += 1
                part = texts[at:to]
                keep, n_a, n_b, groups, pairs, times = [], [], [], [], [], []
                for row, (text, a, b) in enumerate(zip(part, one.encode(part), two.encode(part), strict=True)):
                    want = b" " + text.encode()
                    if one.model.decode_bytes(a) != want or b"".join(map(two.bytes.__getitem__, b)) != want:
                        continue
                    shown, left, right = align(a, b, one.sizes, two.sizes, one.names, two.names)
                    value, count = np.unique(left << 32 | right, return_counts=True)
                    for out, x in zip((keep, n_a, n_b, groups, pairs, times), (at + row, len(a), len(b), shown, value, count), strict=True):
                        out.append(x)
                take = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(take) for c in ("k1", "k2", "docs")), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(groups, pa.string()),
                     pa.array(pairs, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))],
                    names=["k1", "k2", "docs", "n_a", "n_b", "groups", "pairs", "times"])
                at = to

    text = F.col(f"`{text_col}`").alias("text")
    distinct = docs.select(text).filter(F.length("text") > 0).groupBy("text").agg(F.count(F.lit(1)).alias("docs"))
    key = text_key(F.col("text"))
    return distinct.select(key["a"].alias("k1"), key["b"].alias("k2"), "docs", "text").mapInArrow(run, SCHEMA)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, best): how many links of the corpus hold the pair, and whether none of its B id is held more often. At most one
    row per pair of ids, however large the corpus."""
    each = aligned.select("docs", F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum(F.col("docs") * F.col("x.times")).alias("count"))
    each = materialize(each)
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    highest = each.groupBy(b.alias("b")).agg(F.max("count").alias("highest"))
    return materialize(each.join(highest, b == F.col("b")).select("pair", "count", (F.col("count") == F.col("highest")).alias("best")))


def tokenizer_alignment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS, a_file: str = A_FILE,
                        b_file: str = B_FILE, shown: Column | None = None) -> DataFrame:
    """A row per input row: id, n_a, n_b (tokens of both sides), n_groups, n_links, n_best, count_sum, groups. ``shown``, an
    expression of the column groups, says what is returned of it; it is worked out once per distinct text.

    A link is a token of each side that end together; the count of its id pair is how many links of all rows hold it.
    n_best: links whose count is the highest of their B id's, ties included; count_sum: the sum of all links' counts; groups:
    ids of both sides between the offsets where tokens end together (``a1,a2|b1;a3|b2``).

    Null and empty texts, and texts that a vocabulary does not spell out as a space and the text, have no tokens: zeros and
    groups null. Equal texts count as often as they occur, also under one id; ids may be null. An empty table gives an
    empty result. Columns other than id and text are not read.
    """
    spark = docs.sparkSession
    # Groups are long runs of digits, which this codec packs twice as tight.
    path = new_folder(spark, "aligned")
    aligned_texts(docs, text_col, folder, a_file, b_file).write.option("compression", "zstd").parquet(path)
    aligned = spark.read.schema(SCHEMA).parquet(path)
    counts = pair_counts(aligned)
    counts = F.broadcast(counts) if counts.count() <= MAX_BROADCAST_PAIRS else counts
    links = aligned.select("k1", "k2", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("k1", "k2", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    per_text = materialize(links.join(counts, "pair").groupBy("k1", "k2").agg(
        F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum")))
    n_groups = F.when(F.col("groups") == "", 0).otherwise(F.char_length("groups") - F.char_length(F.translate("groups", ";", "")) + 1)
    of_text = aligned.select("k1", "k2", "docs", "n_a", "n_b", n_groups.cast("bigint").alias("n_groups"), (F.col("groups") if shown is None else shown).alias("groups"))
    measures = materialize(of_text.join(per_text, ["k1", "k2"]))
    key = text_key(F.col(f"`{text_col}`"))
    rows = docs.select(F.col(f"`{id_col}`").alias("__id"), key["a"].alias("k1"), key["b"].alias("k2"))
    # A text of many documents is one key. Texts with a thousandth of all rows each are few, and joined without a shuffle of
    # the rows where they are small as well.
    total = measures.agg(F.sum("docs")).first()[0] or 0
    hot = F.col("docs") * HOT_SHARE > total
    few = measures.filter(hot)
    size = few.agg(F.sum(F.octet_length("groups"))).first()[0] or 0
    if 0 < size <= MAX_BROADCAST_BYTES:
        rows = materialize(rows)
        found = rows.join(F.broadcast(few), ["k1", "k2"])
        rest = rows.join(F.broadcast(few.select("k1", "k2")), ["k1", "k2"], "left_anti")
        found = found.unionByName(rest.join(measures.filter(~hot), ["k1", "k2"], "left"))
    else:
        found = rows.join(measures, ["k1", "k2"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return found.select(F.col("__id").alias(id_col), *[zero(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], "groups")


@query("op11_tokenizer_alignment")
def op11_tokenizer_alignment(spark, sf_dir):
    digest = F.sha2(F.col("groups").cast("binary"), 256)
    out = tokenizer_alignment(table(spark, sf_dir, "documents"), shown=digest)
    return out.withColumn("groups_sha256", F.coalesce("groups", F.lit(""))).drop("groups")
