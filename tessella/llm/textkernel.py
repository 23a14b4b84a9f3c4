"""Vectorised text kernels shared by the corpus operators.

Everything here works on the UTF-8 buffer of a whole Arrow string column at
once, so no Python loop runs per word.  A *word* is a maximal run of bytes
outside ``\\x20 \\x09-\\x0D``; those separators are ASCII, so splitting the
UTF-8 bytes is the same as splitting the code points.

Memory is bounded by cutting a column into slices of about ``SLICE_BYTES``
(:func:`slices`); one text longer than that is a slice of its own and is
hashed block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
SLICE_ROWS = 4096
_BLOCK = 1 << 14
_MASK = (1 << 64) - 1



def is_separator(raw: np.ndarray) -> np.ndarray:
    """Which bytes are white space (arithmetic is several times faster here than a lookup)."""
    return ((raw - np.uint8(9)) < np.uint8(5)) | (raw == np.uint8(32))


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes as they are."""
    return raw + (((raw - np.uint8(65)) < np.uint8(26)).view(np.uint8) << np.uint8(5))


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element-wise (a bijection on uint64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9DDFEA08EB382D69 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & _MASK, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER = _powers(_BASE, _BLOCK + 1)
_INVERSE_POWER = _powers(_INVERSE, _BLOCK + 1)


def text_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null text counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    n = len(column)
    if offsets is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    o = np.frombuffer(offsets, dtype=np.int64, count=n + 1 + column.offset)[column.offset :]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[o[0] : o[-1]], o - o[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``rows`` rows that hold at most ``limit`` bytes, or one row."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(n, at + rows, max(at + 1, to))
        yield at, to
        at = to


@dataclass
class Words:
    """The words of a slice of rows: their bytes and the words of row ``i`` at ``first[i]:first[i+1]``."""

    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def find_words(raw: np.ndarray, offsets: np.ndarray) -> Words:
    """Word boundaries; a word never reaches over the end of its row."""
    n = len(raw)
    if not n:
        zero = np.zeros(0, np.int64)
        return Words(raw, zero, zero, np.zeros(len(offsets), np.int64))
    inside = ~is_separator(raw)
    edge = np.empty(n + 1, dtype=bool)
    edge[0], edge[-1] = True, True
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    edge[offsets] = True
    at = np.flatnonzero(edge)
    runs = inside[at[:-1]]
    start, end = at[:-1][runs], at[1:][runs]
    return Words(raw, start, end, np.searchsorted(start, offsets, side="left"))


def hash_spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each byte span (ascending and disjoint; spans may be empty).

    A polynomial over the bytes, modulo 2**64 with a fixed odd base, from
    prefix sums of blocks, then mixed with the length, so that it costs a few operations a
    byte whatever the lengths are.
    """
    out = np.zeros(len(start), dtype=np.uint64)
    if lower:
        raw = lower_ascii(raw)
    at = 0
    while at < len(start):
        base = int(start[at])
        to = int(np.searchsorted(end, base + _BLOCK, side="right"))
        if to <= at:
            out[at] = _hash_long(raw[base : int(end[at])])
            at += 1
            continue
        stop = int(end[to - 1])
        total = np.zeros(stop - base + 1, dtype=np.uint64)
        np.multiply(raw[base:stop], _POWER[: stop - base], out=total[1:])
        np.cumsum(total[1:], out=total[1:])
        s = start[at:to] - base
        out[at:to] = (total[end[at:to] - base] - total[s]) * _INVERSE_POWER[s]
        at = to
    return mix64(out + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _hash_long(raw: np.ndarray) -> np.uint64:
    total, scale = 0, 1
    step = pow(_BASE, _BLOCK, 1 << 64)
    for i in range(0, len(raw), _BLOCK):
        part = raw[i : i + _BLOCK]
        total = (total + scale * int((part * _POWER[: len(part)]).sum(dtype=np.uint64))) & _MASK
        scale = scale * step & _MASK
    return np.uint64(total)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of ``n`` word hashes, over row ends too: mask them with :func:`ngram_valid`."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, dtype=np.uint64)
    multiplier = np.uint64(0xD1342543DE82EF95)
    for i in range(n):
        out *= multiplier
        out += words[i : i + count]
    return mix64(out)


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The same kind of hash for long runs, by prefix sums: the cost doesn't depend on ``n``."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(count, dtype=np.uint64)
    step = _BLOCK - n
    for at in range(0, count, step):
        part = words[at : at + step + n]
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * _POWER[: len(part)], out=total[1:])
        m = min(step, count - at)
        out[at : at + m] = (total[n : n + m] - total[:m]) * _INVERSE_POWER[:m]
    return mix64(out)


def ngram_valid(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of the ``total - n + 1`` runs of :func:`ngram_hashes` lie in one row."""
    count = total - n + 1
    if count <= 0:
        return np.zeros(0, bool)
    left = np.repeat(first[1:], np.diff(first))[:count] - np.arange(count)
    return left >= n
