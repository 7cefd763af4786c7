"""Benchmark decontamination: Wu-Manber multi-pattern search over word sequences.

The patterns are all windows of ``window`` consecutive words of the benchmark
items; an item of fewer words is one shorter pattern.  The Wu-Manber symbols are
words and a block is two words (one, for one-word patterns):

* a shift table says for each block of the patterns' first m words how far the
  search may move when it ends on that block; a block in no pattern moves it by
  m - 1, so most positions of a clean document are never looked at;
* where the shift is zero the last block selects a bucket of patterns (its
  suffix bucket), in which those with the hash of the words seen are looked up;
* a direct comparison of the words confirms each occurrence.

Patterns of one length share a machine, so short items do not shorten the shifts
of the long windows.  A pattern is the number of its first word in the words of all
items, the tables are arrays: some 40 bytes a benchmark word.

The benchmark is read in blocks of at most ``block_words`` words, each compiled
once in a Python worker from a broadcast of that bounded size; every block searches all
documents, and the per-document results of the blocks are merged by position,
so the benchmark may be of any size.

Defined cases: a null or empty text has no words and is not contaminated; a null
item text has no words and no pattern; items repeated under one id count once;
an item whose id is null marks its words as hit but has no id to list.  Repeated
document rows each give a row.  Only the columns named here are read, so extra
columns cannot clash.  With an empty benchmark nothing is hit.
"""

from __future__ import annotations

import hashlib
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pingpath.llm.wordtable import ALNUM, as_strings

#: Maps A-Z to a-z and every byte outside words to a blank.
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if ALNUM[b] else 32 for b in range(256))

OUT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def split_words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


#: Multiplier of the hash of a pattern's words, modulo 2**64.
_MULT = 0x9E3779B97F4A7C15
_ALL = 2**64 - 1
#: Least and most slots of a shift table, as powers of two.
_SLOTS = (20, 24)


class Words:
    """The words of many items: one byte string, where each word begins, and the hash of each (this process's ``hash``)."""

    def __init__(self, items: Iterable[list[bytes]]):
        texts, sizes, hashes = [], [], []
        for words in items:
            texts.append(b" ".join(words) + b" ")
            sizes.append(np.fromiter((len(w) + 1 for w in words), np.int32, len(words)))
            hashes.append(np.fromiter((hash(w) for w in words), np.int64, len(words)))
        self.text = b"".join(texts)
        size = np.concatenate(sizes) if sizes else np.zeros(0, np.int32)
        self.first = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=self.first[1:])
        self.hashes = np.concatenate(hashes).view(np.uint64) if hashes else np.zeros(0, np.uint64)

    def joined(self, start: int, m: int) -> bytes:
        return self.text[self.first[start]:self.first[start + m] - 1]


class WuManber:
    """Search for word patterns that all have the same length m."""

    def __init__(self, patterns: Iterable[tuple[bytes, ...]], m: int):
        patterns = list(patterns)
        self._compile(Words(patterns), np.arange(len(patterns), dtype=np.int64) * m, m)

    @classmethod
    def over(cls, words: Words, starts: np.ndarray, m: int) -> WuManber:
        """The patterns are the m words from each of ``starts`` on."""
        machine = cls.__new__(cls)
        machine._compile(words, starts, m)
        return machine

    def _compile(self, words: Words, starts: np.ndarray, m: int) -> None:
        self.words, self.m, self.block = words, m, 2 if m > 1 else 1
        low, high = _SLOTS
        self.mask = 2 ** min(max((8 * len(starts)).bit_length(), low), high) - 1
        shift = np.full(self.mask + 1, m - self.block + 1, np.uint8 if m < 256 else np.uint32)
        for end in range(self.block, m + 1):  # later ends mean shorter shifts, so the last one written is the least
            shift[self._slots(starts + end)] = m - end
        self._shift = memoryview(shift)
        key = np.zeros(len(starts), np.uint64)
        for i in range(m):
            key = key * np.uint64(_MULT) + words.hashes[starts + i]
        slot = self._slots(starts + m)
        order = np.lexsort((key, slot))
        self.bucket, self.keys = memoryview(slot[order]), memoryview(key[order])
        self.starts = starts[order].astype(np.int32)

    def _slots(self, ends: np.ndarray) -> np.ndarray:
        h = self.words.hashes.view(np.int64)  # Python's own hash, so that >> keeps the sign on both sides
        value = h[ends - 1] if self.block == 1 else (h[ends - 2] >> 20) ^ h[ends - 1]
        return (value & self.mask).astype(np.int32)

    @property
    def shift(self) -> dict[tuple, int]:
        """The shift of every block of the patterns (the least one, where blocks share a slot)."""
        out = {}
        for start in self.starts.tolist():
            for end in range(self.block, self.m + 1):
                block = tuple(self.words.joined(start + end - self.block, self.block).split(b" "))
                out[block] = self._shift[self._slots(np.array([start + end]))[0]]
        return out

    def hits(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """(position, first words of the patterns that occur there)."""
        m, two, shift, mask = self.m, self.block == 2, self._shift, self.mask
        at, n = m, len(words)
        while at <= n:
            slot = ((hash(words[at - 2]) >> 20) ^ hash(words[at - 1]) if two else hash(words[at - 1])) & mask
            s = shift[slot]
            if s:
                at += s
                continue
            found = self._select(slot, words[at - m:at])
            if found:
                yield at - m, found
            at += 1

    def _select(self, slot: int, seen: list[bytes]) -> list[int]:
        a = bisect_left(self.bucket, slot)
        b = bisect_right(self.bucket, slot, a)
        if a == b:
            return []
        key = 0
        for w in seen:
            key = (key * _MULT + hash(w)) & _ALL
        a = bisect_left(self.keys, key, a, b)
        b = bisect_right(self.keys, key, a, b)
        if a == b:
            return []
        joined = b" ".join(seen)
        return [s for s in self.starts[a:b].tolist() if self.words.joined(s, self.m) == joined]

    def find(self, words: list[bytes]) -> Iterator[tuple[int, tuple]]:
        """(start, pattern) of every occurrence."""
        for at, starts in self.hits(words):
            for _ in starts:
                yield at, tuple(words[at:at + self.m])


class Benchmark:
    """Machines, one per pattern length, and the item of each benchmark word."""

    def __init__(self, items: Iterable[tuple[object, bytes]], window: int):
        self.ids: list = []
        sizes: list[int] = []

        def split() -> Iterator[list[bytes]]:
            for item_id, text in items:
                w = split_words(text)
                if w:
                    self.ids.append(item_id)
                    sizes.append(len(w))
                    yield w

        words = Words(split())
        size = np.array(sizes, np.int64)
        begins = np.cumsum(size) - size
        self.item = np.repeat(np.arange(len(size), dtype=np.int32), size)
        self.machines = []
        for m in sorted({min(n, window) for n in sizes}):
            of_length = np.minimum(size, window) == m
            count = size[of_length] - m + 1  # windows of each item
            starts = np.repeat(begins[of_length] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            self.machines.append(WuManber.over(words, starts, m))

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Hit intervals [from, to) and the ids of the items that occur."""
        spans, found = [], set()
        for machine in self.machines:
            for at, starts in machine.hits(words):
                spans.append((at, at + machine.m))
                found.update(self.item[starts].tolist())
        return merge(spans), {self.ids[i] for i in found}


#: The machine of the block that this worker searches.
_BUILT: dict[str, Benchmark] = {}


def _machine(block: str, items: Callable[[], list[tuple]], window: int) -> Benchmark:
    """The compiled block, built once in a worker whatever number of tasks it runs."""
    if block not in _BUILT:
        _BUILT.clear()
        _BUILT[block] = Benchmark(items(), window)
    return _BUILT[block]


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _digest(items: Iterable[object]) -> tuple[int, str]:
    ids = sorted(str(i) for i in items if i is not None)
    return len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest()


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple]]:
    """The items in blocks of bounded size, read one partition at a time."""
    block, words = [], 0
    for row in benchmark.select("item_id", "text").where(F.col("text").isNotNull()).toLocalIterator():
        text = row[1].encode()
        n = len(text) // 2 + 1
        if block and words + n > block_words:
            yield block
            block, words = [], 0
        block.append((row[0], text))
        words += n
    yield block


def _search_block(docs: DataFrame, block: list[tuple], window: int, spans: bool) -> DataFrame:
    shared, name = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(name, lambda: shared.value, window)
        for batch in batches:
            texts = as_strings(batch.column("text")).cast(pa.binary())
            rows = []
            for value in texts:
                w = split_words(value.as_py())
                rows.append((len(w), *machine.search(w)))
            cols = {"doc_id": batch.column("doc_id"), "n_words": pa.array([r[0] for r in rows], pa.int64())}
            if spans:
                cols["row"] = batch.column("row")
                cols["spans"] = pa.array([[list(s) for s in r[1]] for r in rows], pa.list_(pa.list_(pa.int64())))
                cols["items"] = pa.array([[str(i) for i in r[2] if i is not None] for r in rows], pa.list_(pa.string()))
            else:
                hit = [sum(b - a for a, b in r[1]) for r in rows]
                digests = [_digest(r[2]) for r in rows]
                cols |= {"n_hit": pa.array(hit, pa.int64()), "n_items": pa.array([d[0] for d in digests], pa.int64()),
                         "items_sha256": pa.array([d[1] for d in digests], pa.string()),
                         "contaminated": pa.array(np.array(hit, dtype=np.int64) > 0)}
            yield pa.RecordBatch.from_pydict(cols)

    doc_type = docs.schema["doc_id"].dataType.simpleString()
    if spans:
        schema = f"doc_id {doc_type}, n_words long, row long, spans array<array<long>>, items array<string>"
        return docs.select("doc_id", "text", "row").mapInArrow(run, schema)
    return docs.select("doc_id", "text").mapInArrow(run, OUT.replace("doc_id long", f"doc_id {doc_type}"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10,
                       block_words: int = 4_000_000) -> DataFrame:
    """One row per document row: how many of its words lie in benchmark windows, and of which items."""
    blocks = _blocks(benchmark, block_words)
    block, after = next(blocks), next(blocks, None)
    if after is None:
        return _search_block(docs, block, window, spans=False)

    from pingpath.llm.common import staged
    keyed = staged(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "decontam-docs")
    parts = staged(_search_block(keyed, block, window, spans=True), "decontam-part")
    while after is not None:
        more = _search_block(keyed, after, window, spans=True).where(F.size("spans") > 0)
        parts = parts.unionByName(staged(more, "decontam-part"))
        after = next(blocks, None)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.to_pydict()
            hit = [sum(b - a for a, b in merge([tuple(s) for one in x for s in one])) for x in d["spans"]]
            digests = [_digest({i for one in x for i in one}) for x in d["items"]]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_words": batch.column("n_words"),
                "n_hit": pa.array(hit, pa.int64()), "n_items": pa.array([x[0] for x in digests], pa.int64()),
                "items_sha256": pa.array([x[1] for x in digests], pa.string()),
                "contaminated": pa.array(np.array(hit, dtype=np.int64) > 0)})

    merged = parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
                                      F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    return merged.select("doc_id", "n_words", "spans", "items").mapInArrow(
        close, OUT.replace("doc_id long", f"doc_id {doc_type}"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10,
                      block_words: int = 4_000_000) -> DataFrame:
    """The documents with no word in a benchmark window, all columns kept, block by block."""
    for block in _blocks(benchmark, block_words):
        docs = _without_hits(docs, block, window)
    return docs


def _without_hits(docs: DataFrame, block: list[tuple], window: int) -> DataFrame:
    shared, name = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(name, lambda: shared.value, window)
        for batch in batches:
            texts = as_strings(batch.column("text")).cast(pa.binary())
            yield batch.filter(pa.array([not machine.search(split_words(t.as_py()))[0] for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


ORACLE = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '),
      lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(regexp_replace(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '),
      lambda x: x <> '') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS m,
      array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT m FROM p),
dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS win
      FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lens WHERE len(w) >= m)),
occ AS (SELECT dw.doc_id, dw.i, dw.m, p.item_id FROM dw JOIN p ON dw.win = p.win AND dw.m = p.m),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM
      (SELECT doc_id, unnest(range(i, i + m)) AS k FROM (SELECT DISTINCT doc_id, i, m FROM occ)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM
      (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM occ WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""
