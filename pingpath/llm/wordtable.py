"""Vectorised word tables over Arrow string batches.

A mapper that looks at every word of every text spends its time in the word
loop.  Here a slice of texts becomes one byte buffer; words are start and end
offsets found by a 256-entry byte-class table, and 64-bit word hashes come from
prefix sums of a polynomial, so no Python object is made per word.

All functions work on UTF-8 bytes: bytes of 0x80 and above never separate
words, so a class over code points below 0x80 is exact on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RADIX = 0x9E3779B97F4A7C15 | 1
_RADIX_INV = pow(_RADIX, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


class _Tables:
    """Power tables, grown on demand to the longest buffer seen."""

    up = _powers(_RADIX, 1 << 12)
    down = _powers(_RADIX_INV, 1 << 12)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            cls.up, cls.down = _powers(_RADIX, size), _powers(_RADIX_INV, size)
        return cls.up, cls.down


def _byte_values(lower: bool) -> np.ndarray:
    v = np.random.default_rng(0x5EED).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64)
    if lower:
        v[65:91] = v[97:123]
    return v


_VALUES = {True: _byte_values(True), False: _byte_values(False)}

#: True for bytes that belong to a word.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over the 64 output bits."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def as_strings(col: pa.Array) -> pa.Array:
    """The column as a string array whose nulls are empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_null(col.type):
        return pa.array([""] * len(col), pa.string())
    return col.fill_null("")


def slices(batch: pa.RecordBatch, column: str, max_bytes: int, max_rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Row slices of about ``max_bytes`` of text, so temporaries stay small.

    A text longer than that is a slice of its own.
    """
    ends = np.cumsum(_lengths(as_strings(batch.column(column))))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = min(at + max_rows, max(at + 1, int(np.searchsorted(ends, base + max_bytes, side="right"))))
        yield batch.slice(at, to - at)
        at = to


def _lengths(col: pa.Array) -> np.ndarray:
    _, offsets = _buffers(col)
    return np.diff(offsets)


def _buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    width = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=width)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of a slice of texts: byte buffer, text offsets, word offsets and owners."""

    buf: np.ndarray      # bytes of all texts, end to end
    offsets: np.ndarray  # text i is buf[offsets[i]:offsets[i + 1]]
    start: np.ndarray    # first byte of each word
    end: np.ndarray      # one past its last byte
    doc: np.ndarray      # text number of each word

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)

    def prefix_sums(self, lower: bool) -> np.ndarray:
        up, _ = _Tables.upto(len(self.buf) + 1)
        sums = np.zeros(len(self.buf) + 1, dtype=U64)
        np.cumsum(_VALUES[lower][self.buf] * up[:len(self.buf)], out=sums[1:])
        return sums

    def hashes(self, lower: bool, sums: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """64-bit hash of each word (of its bytes up to ``end``); A-Z count as a-z if ``lower``."""
        sums = self.prefix_sums(lower) if sums is None else sums
        end = self.end if end is None else end
        _, down = _Tables.upto(len(self.buf) + 1)
        return mix((sums[end] - sums[self.start]) * down[self.start] + (end - self.start).astype(U64))


def words(col: pa.Array, is_word: np.ndarray) -> Words:
    """Word table of a string column; nulls are empty texts."""
    buf, offsets = _buffers(as_strings(col))
    inside = np.zeros(len(buf) + 1, dtype=bool)
    inside[:-1] = is_word[buf]
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2]
    finish = inside[:-1] & ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(buf))]
    begins[edges] = inside[edges]
    finish[edges - 1] = inside[edges - 1]
    start = np.flatnonzero(begins)
    doc = np.searchsorted(offsets, start, side="right") - 1
    return Words(buf, offsets, start, np.flatnonzero(finish) + 1, doc)
