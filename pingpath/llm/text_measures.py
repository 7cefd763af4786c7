"""Per-text measures for the quality rules, a slice of texts at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from pingpath.llm.wordtable import ALNUM, NOT_SPACE, U64, Words, _VALUES, _Tables, mix, words

#: [#*$%&|<>] (fixed value).
SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_FIRST = np.ones(256, dtype=bool)  # first byte of a code point
_FIRST[0x80:0xC0] = False
_MARK = ~ALNUM & NOT_SPACE

NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks"]


def owner_key(h: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """One sortable key for (text, hash): the text's number in the top bits."""
    bits = max(1, int(n_docs - 1).bit_length())
    return (doc.astype(U64) << U64(64 - bits)) | (h >> U64(bits))


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeated_words(w: Words) -> np.ndarray:
    """Words of each text that lie in a 3-word window found twice or more in it."""
    h, n = w.hashes(lower=False), len(w.doc)
    if n < 3:
        return np.zeros(w.n_docs, dtype=np.int64)
    win = mix(mix(mix(h[:-2]) + h[1:-1]) + h[2:])
    whole = w.doc[:-2] == w.doc[2:]
    key = owner_key(win, w.doc[:-2], w.n_docs)
    ordered = np.sort(key[whole])
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(w.n_docs, dtype=np.int64)
    at = np.searchsorted(twice, key)
    again = whole & (twice[np.minimum(at, len(twice) - 1)] == key)
    hit = np.zeros(n, dtype=bool)
    for i in range(3):
        hit[i:n - 2 + i] |= again
    return np.bincount(w.doc[hit], minlength=w.n_docs)


def _duplicate_lines(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(lines, lines with a word that equal an earlier line) of each text."""
    newline = w.buf == 0x0A
    n_lines = _per_text(newline, w.offsets) + 1
    breaks = np.flatnonzero(newline)
    start = np.sort(np.concatenate([w.offsets[:-1], breaks + 1]), kind="stable")
    doc = np.repeat(np.arange(w.n_docs), n_lines)
    end = np.concatenate([start[1:], w.offsets[-1:]])
    last = np.concatenate([doc[1:] != doc[:-1], [True]])  # the last line of a text ends with it, others before \n
    end = np.where(last, end, end - 1)
    sums = w.prefix_sums(lower=False)
    _, down = _Tables.upto(len(w.buf) + 1)
    h = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64))
    filled = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    key = np.sort(owner_key(h[filled], doc[filled], w.n_docs))
    repeats = key[1:][key[1:] == key[:-1]]
    bits = max(1, int(w.n_docs - 1).bit_length())
    return n_lines, np.bincount((repeats >> U64(64 - bits)).astype(np.int64), minlength=w.n_docs)


def measures(texts: pa.Array) -> dict[str, np.ndarray]:
    w = words(texts, NOT_SPACE)
    in_word = NOT_SPACE[w.buf]
    n_lines, dup = _duplicate_lines(w)
    return {
        "n_words": w.counts(),
        "word_chars": _per_text(in_word & _FIRST[w.buf], w.offsets),
        "n_symbols": _per_text(SYMBOL[w.buf], w.offsets),
        "n_dup_lines": dup,
        "n_repeat_words": _repeated_words(w),
        "n_lines": n_lines,
        "n_upper": _per_text(_UPPER[w.buf], w.offsets),
        "n_marks": _per_text(_MARK[w.buf], w.offsets),
    }
