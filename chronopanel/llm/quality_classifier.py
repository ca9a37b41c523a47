"""A quality classifier that learns from preferences (Bradley-Terry).

A document's score is a weighted sum of features of its text, and a document is preferred to another with a
probability that depends on the difference of their scores alone. Weights are fitted by logistic loss on feature
differences of preference pairs: of a good and a bad document each. The threshold is the quantile of the scores that cuts off
as many labelled documents as are bad.

Features are counts of the whole text: shares of character classes and of pairs of them, word lengths, and how much
words and lines repeat. They are computed in numpy per document and know no word of any language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.llm.hashing import SPACED, gram_hashes, in_pieces, numbers, word_hashes
from chronopanel.llm.registry import query, table

# Labelled rows that are read for the fit, those of lowest id hash, and pairs that are made of them.
MAX_LABELLED = 8_000
MAX_PAIRS = 40_000
PAIRS_AT_ONCE = 4_000

# Classes of bytes: what is not named is 0.
_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\r\x0b\x0c", b".", b",", b"!?",
            b"'\"`", b"-_/\\", b"()[]{}", b"#*$%&|<>", b":;@=+^~", bytes(range(128, 192)), bytes(range(192, 256))]
N_CLASSES = len(_CLASSES) + 1


def _class_table() -> np.ndarray:
    out = np.zeros(256, np.uint16)
    for i, chars in enumerate(_CLASSES, 1):
        out[list(chars)] = i
    return out


CLASS_OF = _class_table()
N_SCALARS = 9
N_FEATURES = N_SCALARS + N_CLASSES + N_CLASSES * N_CLASSES


def features(text: bytes, words: np.ndarray) -> np.ndarray:
    """Of one text and its word hashes; all 0 for an empty text."""
    out = np.zeros(N_FEATURES, np.float32)
    if not text:
        return out
    kinds = CLASS_OF[np.frombuffer(text, np.uint8)]
    single = np.bincount(kinds, minlength=N_CLASSES)
    double = np.zeros(N_CLASSES * N_CLASSES)
    for at in range(0, len(kinds) - 1, 1 << 20):
        part = kinds[at : at + (1 << 20) + 1]
        double += np.bincount(part[:-1] * N_CLASSES + part[1:], minlength=N_CLASSES * N_CLASSES)
    n, chars = max(len(words), 1), len(text)
    solid = max(chars - int(single[4] + single[5] + single[6]), 1)
    lines = [x for x in text.split(b"\n") if x.strip()]
    triples = gram_hashes(words, 3)
    different = len(np.unique(words))
    out[:N_SCALARS] = (
        min(solid / n, 40) / 10,
        different / n,
        np.log1p(n) / 10,
        1 - len(np.unique(triples)) / max(len(triples), 1) if len(triples) else 0,
        1 - len(set(lines)) / max(len(lines), 1) if lines else 0,
        np.bincount(np.unique(words, return_inverse=True)[1]).max() / n if len(words) else 0,
        single[13] / n,
        single[9] / n,
        single[2] / solid,
    )
    out[N_SCALARS : N_SCALARS + N_CLASSES] = single / chars
    out[N_SCALARS + N_CLASSES :] = double / chars
    return out


def feature_rows(docs: DataFrame, keys: list[str], text_col: str, packed: bool = False) -> DataFrame:
    """``keys`` and ``x``, an array of features, per row; ``packed``: as the bytes of 32-bit floats."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in in_pieces(batches, keys, "__text"):
            rows = [features(t, w) for t, w in zip(texts, word_hashes(texts, SPACED), strict=True)]
            x = pa.array([r.tobytes() for r in rows], pa.binary()) if packed else pa.array(rows, pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*(ids[k] for k in keys), x], names=[*keys, "x"])

    src = docs.select(*keys, F.col(f"`{text_col}`").cast("binary").alias("__text"))
    kinds = dict(src.dtypes)
    return src.mapInArrow(compute, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + (", x binary" if packed else ", x array<float>"))


@dataclass
class Preference:
    """score = 1 / (1 + exp(-(weights . (x - centre) / spread - threshold) / width))"""

    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    width: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.spread, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.raw(x) - self.threshold) / self.width, -30, 30)))


def preference_pairs(good: int, bad: int, most: int = MAX_PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """(index of a good row, index of a bad row) of each pair: all pairs if they are few, else so many that every row of the
    rarer and of the commoner class is in about as many as any other of its class."""
    if good * bad <= most:
        return np.repeat(np.arange(good), bad), np.tile(np.arange(bad), good)
    k = np.arange(most)
    picked = numbers(61, most) >> np.uint64(11)
    # The commoner class in turn, against a pseudorandom partner from the rarer one.
    if good >= bad:
        return k % good, (picked % np.uint64(bad)).astype(np.int64)
    return (picked % np.uint64(good)).astype(np.int64), k % bad


def fit_preferences(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 60) -> Preference:
    """Newton's method on the pairs' logistic loss with an L2 penalty. Without both classes nothing is learned, and
    every score is a half."""
    n = x.shape[1]
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Preference(np.zeros(n), np.ones(n), np.zeros(n), 0.0, 1.0)
    centre, spread = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = np.clip((x - centre) / spread, -8, 8)
    i, j = preference_pairs(len(good), len(bad))
    w = np.zeros(n)
    for _ in range(rounds):
        gradient, curve = penalty * w, penalty * np.eye(n)
        # Differences are made some pairs at a time: all of them would take many times the rows' memory.
        for at in range(0, len(i), PAIRS_AT_ONCE):
            d = z[good[i[at : at + PAIRS_AT_ONCE]]] - z[bad[j[at : at + PAIRS_AT_ONCE]]]
            p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
            gradient = gradient + d.T @ (p - 1) / len(i)
            curve += (d * (p * (1 - p) / len(i))[:, None]).T @ d
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    model = Preference(centre, spread, w, 0.0, 1.0)
    raw = np.sort(model.raw(x))
    cut = len(bad)  # as many below as are bad
    model.threshold = float((raw[cut - 1] + raw[cut]) / 2) if cut < len(raw) else float(raw[-1]) + 1
    model.width = max(float(raw.std()) / 4, 1e-9)
    return model


def held_out(id_: Column) -> Column:
    """Rows the fit never sees: a third, by the CRC of the id as text. A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit_on_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                  max_labelled: int = MAX_LABELLED) -> Preference:
    """Fit on at most ``max_labelled`` labelled documents that are not held out: those whose ids have the lowest hashes.

    Rows without a label of 0 or 1 or without an id are not read. Of a document with several labels the largest
    counts; repeated documents are rows of their own up to the bound.
    """
    chosen = (
        labels.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{label_col}`").cast("int").alias("__y"))
        .filter(F.col("__id").isNotNull() & F.col("__y").isin(0, 1) & ~held_out(F.col("__id")))
        .groupBy("__id").agg(F.max("__y").alias("__y"))
        .orderBy(F.xxhash64("__id"), "__id").limit(max_labelled)
    )
    near = docs.select(F.col(f"`{id_col}`").alias("__i"), F.col(f"`{text_col}`").alias("__t")).join(F.broadcast(chosen), F.col("__i") == F.col("__id"))
    # Repeated rows could be many: the bound holds for what is collected as well.
    near = near.select("__id", "__y", "__t").orderBy(F.xxhash64("__id", "__t")).limit(max_labelled)
    # A row comes to the driver as its features' bytes: no object per number is made there.
    rows = feature_rows(near, ["__id", "__y"], "__t", packed=True).collect()
    rows.sort(key=lambda r: (r["__id"], bytes(r["x"])))
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), np.float32).reshape(len(rows), N_FEATURES)
    return fit_preferences(x.astype(np.float64), np.asarray([r["__y"] for r in rows], np.int64))


def score_documents(docs: DataFrame, model: Preference, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a column ``score_col``; all columns are kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # Columns go by number, so that no name of the caller's clashes.
    fields = [f"c{i}" for i in range(len(docs.columns))]
    src = docs.select(*[F.col(f"`{c}`").alias(f) for c, f in zip(docs.columns, fields, strict=True)], F.col(f"`{text_col}`").cast("binary").alias("text"))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for ids, texts in in_pieces(batches, fields, "text"):
            x = np.stack([features(t, w) for t, w in zip(texts, word_hashes(texts, SPACED), strict=True)])
            yield pa.RecordBatch.from_arrays([*(ids[c] for c in fields), pa.array(model.score(x.astype(np.float64)))], names=[*fields, "score"])

    schema = ", ".join(f"{f} {k}" for f, (_, k) in zip(fields, docs.dtypes, strict=True)) + ", score double"
    return src.mapInArrow(compute, schema).toDF(*docs.columns, score_col)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                   max_labelled: int = MAX_LABELLED) -> DataFrame:
    """A row per input row: id, held_out, score (0 to 1, higher: better), predicted (1 if score >= 0.5).

    Only the text makes the score. Null and empty texts have features of 0 and a score like others. Null ids are
    scored and not held out. Repeated rows are scored alike. Without labels of both classes every score is 0.5. An empty
    table gives an empty result. Columns other than id and text are not read.
    """
    model = fit_on_labels(docs, labels, id_col, text_col, label_col, max_labelled)
    narrow = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").cast("binary").alias("__t"))
    scored = score_documents(narrow, model, "__t", "__score").select("__id", "__score")
    return scored.select(F.col("__id").alias(id_col), held_out(F.col("__id")).alias("held_out"), F.col("__score").alias("score"),
                         (F.col("__score") >= 0.5).cast("int").alias("predicted"))


@query("op7_quality_classifier")
def op7_quality_classifier(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
