"""Hashes of words and of byte strings, a few megabytes of text at a time, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

# Text that a task turns into arrays at once.
PIECE_BYTES = 2 << 20

U64 = np.uint64
_M1, _M2, _M3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers; every output bit depends on every input bit."""
    x = (x ^ (x >> U64(30))) * _M2
    x = (x ^ (x >> U64(27))) * _M3
    return x ^ (x >> U64(31))


def numbers(seed: int, count: int) -> np.ndarray:
    """Pseudorandom odd 64-bit numbers; the same on every machine."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, count + 1, dtype=U64) * _M1 + U64(seed * 7919)) | U64(1)


BYTE_VALUE = numbers(1, 256)

# A-Z lower-cased; what separates words, as a space.
ALNUM = bytes(c + 32 if 65 <= c <= 90 else (c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32) for c in range(256))
SPACED = bytes(c + 32 if 65 <= c <= 90 else (32 if 9 <= c <= 13 else c) for c in range(256))


def _hash_piece(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word of a translated text; words are what stands between spaces."""
    b = np.frombuffer(data, np.uint8)
    inside = b != 32
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(b) and inside[0]:
        edge = np.concatenate(([0], edge))
    if len(edge) % 2:
        edge = np.append(edge, len(b))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, U64), starts
    at = np.flatnonzero(inside)
    lengths = ends - starts
    firsts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(len(at)) - np.repeat(firsts, lengths)
    value = BYTE_VALUE[b[at]] * numbers(2, int(lengths.max()))[place]
    return mix(np.add.reduceat(value, firsts) ^ lengths.astype(U64)), starts


def word_hashes(texts: list[bytes], table: bytes) -> list[np.ndarray]:
    """For each text, a 64-bit hash per word."""
    out: list[np.ndarray] = [np.empty(0, U64)] * len(texts)
    group: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal group, size
        if group:
            h, starts = _hash_piece(b" ".join(texts[i] for i in group).translate(table))
            bounds = np.cumsum([len(texts[i]) + 1 for i in group])
            for i, part in zip(group, np.split(h, np.searchsorted(starts, bounds[:-1])), strict=True):
                out[i] = part
        group, size = [], 0

    for i, text in enumerate(texts):
        if len(text) > PIECE_BYTES:
            out[i] = _long_text(text, table)
            continue
        if size + len(text) > PIECE_BYTES:
            flush()
        group.append(i)
        size += len(text) + 1
    flush()
    return out


def _long_text(text: bytes, table: bytes) -> np.ndarray:
    """Piece by piece, each cut at its last space."""
    parts, at = [], 0
    while at < len(text):
        end = at + PIECE_BYTES
        piece = text[at:end].translate(table)
        while end < len(text):
            cut = piece.rfind(b" ")
            if cut >= 0:
                piece, end = piece[:cut], at + cut + 1
                break
            more = text[end : end + PIECE_BYTES].translate(table)
            piece, end = piece + more, end + len(more)
        parts.append(_hash_piece(piece)[0])
        at = end
    return np.concatenate(parts) if parts else np.empty(0, U64)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """One hash per run of n consecutive words."""
    size = len(words) - n + 1
    if size <= 0:
        return np.empty(0, U64)
    out = mix(words[:size] + U64(n))
    for i in range(1, n):
        out = mix(out * _M1 + words[i : i + size])
    return out


def in_pieces(batches: Iterator, ids: list[str], text: str, limit: int = PIECE_BYTES * 2) -> Iterator[tuple[dict, list[bytes]]]:
    """Runs of rows whose texts take about ``limit`` bytes: ({id column: values}, texts). Null is empty."""
    for batch in batches:
        column = batch.column(text)
        sizes = np.asarray([len(v) if v is not None else 0 for v in (x.as_buffer() for x in column)], dtype=np.int64) if len(column) else np.empty(0, np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(column):
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            part = batch.slice(at, end - at)
            yield {c: part.column(c) for c in ids}, [v or b"" for v in part.column(text).to_pylist()]
            at = end
