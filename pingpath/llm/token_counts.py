"""Token counts: byte-pair merging with a heap and a linked list.

A piece of text (a match of the vocabulary's split pattern) starts as one symbol
per byte.  The symbols form a doubly linked list; every adjacent pair that the
merge table knows waits in a heap under (rank, position).  The lowest pair is
popped and merged, the list closes over it and its two new neighbours enter the
heap, until no known pair is left.  The count is initial symbols minus merges:
no token ids are produced.

The merge table comes from a tokenizer .json (byte-level BPE).  It is read on the
driver and shared as a broadcast whose size the vocabulary fixes.  Strings of the
vocabulary's special tokens inside texts count as the library's default has it:
one token each.

Pieces repeat, so each worker keeps counts of pieces it has seen in a table of at
most ``cache`` entries, emptied when full; results do not depend on it.

Defined cases: a null text is empty and has 0 tokens; repeated rows each give a
row; extra columns are not read; texts of any length are counted whole.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame

from pingpath.llm.wordtable import as_strings

#: Split pattern of the byte-level vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _printable_bytes() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeTable:
    """Symbols are numbers: bytes first, then one for each merge."""

    def __init__(self, merges: list[tuple[bytes, bytes]], special: list[str]):
        number = {bytes([b]): b for b in range(256)}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            made = number.setdefault(a + b, len(number))
            self.pairs.setdefault((number[a], number[b]), (rank, made))
        self.special = sorted(special, key=len, reverse=True)

    @classmethod
    def from_json(cls, path: str) -> MergeTable:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError(f"{path}: not a plain byte-level BPE vocabulary")
        byte = _printable_bytes()
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        as_bytes = [tuple(bytes(byte[c] for c in part) for part in m) for m in merges]
        return cls(as_bytes, [t["content"] for t in spec["added_tokens"]])


def count_piece(piece: bytes, pairs: dict[tuple[int, int], tuple[int, int]]) -> int:
    """Symbols left after all merges of one piece."""
    n = len(piece)
    if n < 2:
        return n
    symbol = list(piece)
    heap = []
    for i in range(n - 1):
        known = pairs.get((symbol[i], symbol[i + 1]))
        if known:
            heap.append((known[0], i, known[1]))
    if not heap:
        return n
    heapq.heapify(heap)
    following, previous, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
    while heap:
        rank, i, made = heapq.heappop(heap)
        j = following[i]
        if symbol[i] < 0 or j >= n or pairs.get((symbol[i], symbol[j])) != (rank, made):
            continue  # one side has merged with another neighbour since
        merges += 1
        symbol[i], symbol[j] = made, -1
        following[i] = after = following[j]
        before = previous[i]
        if after < n:
            previous[after] = i
            known = pairs.get((made, symbol[after]))
            if known:
                heapq.heappush(heap, (known[0], i, known[1]))
        if before >= 0:
            known = pairs.get((symbol[before], made))
            if known:
                heapq.heappush(heap, (known[0], before, known[1]))
    return n - merges


class Counter:
    """Counts the tokens of whole texts; keeps a bounded table of pieces."""

    def __init__(self, table: MergeTable, cache: int):
        self.pairs, self.special, self.limit = table.pairs, table.special, cache
        self.cut = regex.compile("|".join(map(regex.escape, table.special))) if table.special else None
        self.pieces = regex.compile(PATTERN).findall
        self.known = _Known(table.pairs)

    def count(self, text: str) -> int:
        if len(self.known) > self.limit:
            self.known.clear()
        if self.cut is None or not any(s in text for s in self.special):
            return sum(map(self.known.__getitem__, self.pieces(text)))
        parts = self.cut.split(text)
        return len(parts) - 1 + sum(sum(map(self.known.__getitem__, self.pieces(p))) for p in parts)


class _Known(dict):
    def __init__(self, pairs):
        super().__init__()
        self.pairs = pairs

    def __missing__(self, piece: str) -> int:
        n = count_piece(piece.encode("utf-8"), self.pairs)
        if len(piece) <= 64:
            self[piece] = n
        return n


_COUNTERS: dict[tuple, Counter] = {}


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024, cache: int = 400_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether a text has more than ``limit`` tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(MergeTable.from_json(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (vocabulary, cache)
        if key not in _COUNTERS:  # a worker keeps its table from task to task
            _COUNTERS[key] = Counter(shared.value, cache)
        count = _COUNTERS[key].count
        for batch in batches:
            texts = as_strings(batch.column("text"))
            tokens = np.array([count(t.as_py()) for t in texts], dtype=np.int64)
            sizes = pa.compute.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_bytes": sizes, "n_tokens": pa.array(tokens, pa.int64()),
                "over_limit": pa.array(tokens > limit)})

    doc_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {doc_type}, n_bytes long, n_tokens long, over_limit boolean")
