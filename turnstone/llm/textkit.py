"""Texts of Arrow batches as flat arrays: slices of bounded size, words and their hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Byte -> lower-case word byte, 0 where no word byte. All of UTF-8 beyond ASCII counts as word.
_LOWER = np.zeros(256, np.uint8)
for _c in range(256):
    if _c >= 128 or chr(_c).isalnum():
        _LOWER[_c] = ord(chr(_c).lower()) if _c < 128 else _c
_LATIN = _LOWER.copy()
_LATIN[0x80:0x9F] += 0x20  # second bytes of À to Þ
_LATIN[0x97] = 0x97


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A finalizer that spreads every bit of ``h``."""
    h = h + _U((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (1 << 64) - 1)
    h ^= h >> _U(30)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets into them; a null is an empty text."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    n = len(texts)
    if n == 0 or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    if texts.null_count:
        texts = texts.fill_null("")
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32, n + 1, texts.offset * (8 if wide else 4)).astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows whose texts come to ``limit`` bytes at most, one row at least."""
    _, offsets = raw(batch.column(column))
    lo, n = 0, batch.num_rows
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield batch.slice(lo, hi - lo)
        lo = hi


class Words:
    """Words of a run of texts: 64-bit ``hash``, ``doc`` and byte range ``start:end`` of each; ``first[d]:first[d+1]`` are those of text d. ``low`` are the texts' lower-case bytes, ``raw`` their bytes."""

    def __init__(self, texts: pa.Array):
        data, offsets = raw(texts)
        n = len(data)
        low = _LOWER[data]
        if n > 1:
            second = np.flatnonzero(data[:-1] == 0xC3) + 1
            low[second] = _LATIN[data[second]]
        self.low, self.raw = low, data
        inside = low != 0
        begins = np.zeros(n + 1, bool)
        begins[offsets] = True  # a text ends the word before it
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | begins[:-1]))
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | begins[1:])) + 1
        up, down = powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((low.astype(np.uint64) + _U(1)) * up[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start])
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
