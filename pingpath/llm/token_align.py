"""Cross-tokenizer alignment: galloping intersection of token end offsets.

Two tokenizers cut the same bytes, so each token ends at a byte offset.  Offsets where
both have an end cut the tokens into groups, and tokens whose byte ranges overlap are
linked.

1. **Blocks.**  A task takes about ``block_bytes`` of whole texts at a time; a longer
   text is a block of its own.  Texts lie end to end, so a block has one ascending list
   of ends per tokenizer.  The shorter list drives: each of its ends starts where the
   longer list would hold it if both ran evenly, doubles its stride until it is passed
   and ends with a binary search (``gallop``), all ends of a block at once.
2. **Groups and links.**  Ends found in both lists slice the groups.  Ranks of successive
   ends differ by the tokens in between, which is the range a token overlaps; no bytes
   are compared.
3. **Corpus counts.**  A block hands on its distinct id pairs with their links once, and
   its documents refer to them by number.  Counts of pairs are one distributed sum, each
   B id's highest another.
4. **Answers.**  Every block gets the counts of its own pairs back (a join of one row per
   block and pair, so a pair found everywhere has no more rows than there are blocks) and
   sums them for its documents.

A's tokens come from its .json in the engine that takes ids as merge ranks, where the file's
merges allow it, else (and for texts with 1,000 white spaces in a row) in the .json's own
library; both give the same ids.  Vocabularies are read on the driver and shared as broadcasts, whose size the files fix.

Defined cases: null and empty texts, and texts that either tokenizer does not give back
byte by byte, have no tokens: zeros and an empty ``groups_sha256``; repeated rows each
give a row and each count in the corpus; null ids are kept; extra columns are not read;
an empty table gives an empty result; texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pingpath.llm.common import staged
from pingpath.llm.token_counts import PATTERN, _printable_bytes
from pingpath.llm.wordtable import as_strings, slices

#: Text that one block holds; its temporaries are some 60 times that.
BLOCK_BYTES = 2 << 20

#: Pre-tokenizer of the byte-level vocabularies (fixed value), which PATTERN stands for.
LEVEL_OF_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
#: White space that the rank engine's split cannot walk; such texts go to the other engine.
LONG_GAP = re.compile(r"\s{1000}")


class Sides:
    """Both tokenizers of a worker, their tokens as bytes, and the decimal texts of their ids."""

    def __init__(self, a_json: str, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
        import sentencepiece
        import tiktoken
        import tokenizers

        self.a = tokenizers.Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        byte = _printable_bytes()
        spec = json.loads(a_json)
        vocab = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.a_bytes = [b""] * (1 + max([*vocab.values(), *special.values()]))
        for piece, i in vocab.items():
            self.a_bytes[i] = bytes(byte[c] for c in piece)
        for piece, i in special.items():
            self.a_bytes[i] = piece.encode("utf-8")
        # merges in the order of their tokens' ids: the ids are ranks, and a faster engine gives the same tokens
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        plain = spec["normalizer"] is None and spec["pre_tokenizer"] == LEVEL_OF_BYTES and made == sorted(set(made))
        self.a_ranks = tiktoken.Encoding("a", pat_str=PATTERN, special_tokens={}, mergeable_ranks={
            self.a_bytes[i]: i for i in vocab.values()}) if plain else None
        pieces = [(i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode("utf-8") for i, p in pieces]
        self.a_size, self.b_size = (np.array(list(map(len, t)), dtype=np.int64) for t in (self.a_bytes, self.b_bytes))
        # a token inside its group is followed by a comma, the last A token by a bar, the last B token by a semicolon
        self.shown = [f"{i}{end}" for n, last in ((len(self.a_bytes), "|"), (len(self.b_bytes), ";")) for i in range(n) for end in (",", last)]
        self.b_from = 2 * len(self.a_bytes)

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Token ids of each text by A and B, both empty where either is not the text's own bytes."""
        spaced = [" " + t for t in texts]
        if self.a_ranks:
            a = [self.a_ranks.encode_ordinary(t) if not LONG_GAP.search(t) else self.a.encode(t, add_special_tokens=False).ids for t in spaced]
        else:
            a = [e.ids for e in self.a.encode_batch(spaced, add_special_tokens=False)]
        b = self.b.encode(texts, num_threads=1)
        for i, t in enumerate(spaced):
            whole = t.encode("utf-8")
            if len(t) == 1 or b"".join(map(self.a_bytes.__getitem__, a[i])) != whole or b"".join(map(self.b_bytes.__getitem__, b[i])) != whole:
                a[i], b[i] = [], []
        return a, b


def gallop(targets: np.ndarray, ends: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each target the number of ``ends`` (ascending) below it, searched outwards from ``start``.

    Strides double until the target is passed, then the bracket is halved.  No target is above the last end.
    """
    last = len(ends) - 1
    start = np.clip(start, 0, last)
    low, high = np.zeros(len(targets), dtype=np.int64), np.full(len(targets), last, dtype=np.int64)
    right = ends[start] < targets
    for way, rows in ((1, np.flatnonzero(right)), (-1, np.flatnonzero(~right))):
        (low if way > 0 else high)[rows] = start[rows] + (way > 0)
        stride = 1
        while len(rows):
            probe = start[rows] + way * stride
            inside = (probe >= 0) & (probe <= last)
            rows, probe = rows[inside], probe[inside]
            below = ends[probe] < targets[rows]
            low[rows[below]], high[rows[~below]] = probe[below] + 1, probe[~below]
            rows = rows[below if way > 0 else ~below]
            stride *= 2
    rows = np.flatnonzero(low < high)
    while len(rows):
        mid = (low[rows] + high[rows]) >> 1
        below = ends[mid] < targets[rows]
        low[rows[below]], high[rows[~below]] = mid[below] + 1, mid[~below]
        rows = rows[low[rows] < high[rows]]
    return low


def _firsts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


@dataclass
class Aligned:
    """Groups and links of a block's texts."""

    a_last: np.ndarray  # tokens that end a group
    b_last: np.ndarray
    a_of: np.ndarray    # links: A token and B token
    b_of: np.ndarray


def align(a_end: np.ndarray, b_end: np.ndarray, a_first: np.ndarray, b_first: np.ndarray) -> Aligned:
    """Intersect two end lists that cover the same bytes; ``*_first`` cut them into texts."""
    swap = len(a_end) > len(b_end)
    short, long, s_first, l_first = (b_end, a_end, b_first, a_first) if swap else (a_end, b_end, a_first, b_first)
    s_last, l_last = np.zeros(len(short), dtype=bool), np.zeros(len(long), dtype=bool)
    if not len(short):
        none = np.zeros(0, np.int64)
        return Aligned(s_last, l_last, none, none)
    s_count, l_count = np.diff(s_first), np.diff(l_first)
    text = np.repeat(np.arange(len(s_count)), s_count)
    guess = l_first[text] + (np.arange(len(short)) - s_first[text]) * l_count[text] // s_count[text]
    below = gallop(short, long, guess)
    s_last = long[below] == short
    l_last[below[s_last]] = True
    first = np.concatenate([[0], (below + s_last)[:-1]])  # ends up to the token before
    n = below - first + 1
    s_of = np.repeat(np.arange(len(short)), n)
    l_of = np.arange(len(s_of)) - np.repeat(_firsts(n)[:-1] - first, n)
    return Aligned(l_last, s_last, l_of, s_of) if swap else Aligned(s_last, l_last, s_of, l_of)


def _group_digests(sides: Sides, a: np.ndarray, b: np.ndarray, found: Aligned, cuts: np.ndarray) -> list[str]:
    """SHA-256 of each text's groups as ``a1,a2|b1;a3|b2``."""
    a_group, b_group = (np.concatenate([[0], np.cumsum(x)[:-1]]) if len(x) else np.zeros(0, np.int64) for x in (found.a_last, found.b_last))
    a_cut, b_cut = np.concatenate([[0], np.flatnonzero(found.a_last) + 1]), np.concatenate([[0], np.flatnonzero(found.b_last) + 1])
    codes = np.empty(len(a) + len(b), dtype=np.int64)
    codes[np.arange(len(a)) + b_cut[a_group]] = 2 * a + found.a_last
    codes[np.arange(len(b)) + a_cut[b_group + 1] if len(b) else []] = sides.b_from + 2 * b + found.b_last
    shown = sides.shown.__getitem__
    out = []
    for i in range(len(cuts) - 1):
        text = "".join(map(shown, codes[cuts[i]:cuts[i + 1]].tolist()))
        out.append(hashlib.sha256(text[:-1].encode("ascii")).hexdigest() if text else "")
    return out


def _ragged(cuts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, kind))


def block_rows(sides: Sides, part: pa.RecordBatch, block: int) -> pa.RecordBatch:
    """The block's documents, and one more row with its distinct pairs and their links.

    Documents name pairs by their number in that row.
    """
    a, b = sides.encode(as_strings(part.column("text")).to_pylist())
    rows = part.num_rows
    a_first, b_first = (_firsts(np.array(list(map(len, x)), dtype=np.int64)) for x in (a, b))
    a_ids = np.fromiter(chain.from_iterable(a), np.int64, a_first[-1])
    b_ids = np.fromiter(chain.from_iterable(b), np.int64, b_first[-1])
    found = align(np.cumsum(sides.a_size[a_ids]), np.cumsum(sides.b_size[b_ids]), a_first, b_first)
    digests = _group_digests(sides, a_ids, b_ids, found, a_first + b_first)
    text = np.repeat(np.arange(rows), np.diff(a_first))
    groups = np.bincount(text[found.a_last], minlength=rows)
    pairs, number, total = np.unique((a_ids[found.a_of] << 32) | b_ids[found.b_of], return_inverse=True, return_counts=True)
    width = max(1, len(pairs))
    each, k = np.unique(text[found.a_of] * width + number, return_counts=True)
    cuts = np.searchsorted(each, np.arange(rows + 1) * width)
    links = np.diff(_firsts(k)[cuts])
    whole = np.append(cuts, cuts[-1] + len(pairs))
    more = pa.array([*part.column("doc_id").to_pylist(), None], part.schema.field("doc_id").type)
    return pa.RecordBatch.from_pydict({
        "doc_id": more, "block": pa.array(np.full(rows + 1, block)), "is_block": pa.array([False] * rows + [True]),
        **{c: pa.array(np.append(x, 0), pa.int64()) for c, x in
           (("n_a", np.diff(a_first)), ("n_b", np.diff(b_first)), ("n_groups", groups), ("n_links", links))},
        "groups_sha256": pa.array([*digests, ""]),
        "pair": _ragged(np.append(np.zeros(rows + 1, np.int64), len(pairs)), pairs, pa.int64()),
        "at": _ragged(np.append(cuts, cuts[-1]), each % width, pa.int32()),
        "k": _ragged(whole, np.concatenate([k, total]), pa.int64())})


_SIDES: dict[str, Sides] = {}


def _encoded(docs: DataFrame, a_json: str, b_model: bytes, block_bytes: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((a_json, b_model))
    key = hashlib.sha256(a_json.encode() + b_model).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _SIDES:  # a worker keeps its tokenizers from task to task
            _SIDES[key] = Sides(*shared.value)
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", block_bytes):
                yield block_rows(_SIDES[key], part, block)
                block += 1

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, block long, is_block boolean, n_a long, n_b long, "
             "n_groups long, n_links long, groups_sha256 string, pair array<long>, at array<int>, k array<long>")


def pair_counts(encoded: DataFrame) -> DataFrame:
    """pair (A id << 32 | B id), count (links in the corpus) and top (whether none of its B id has more)."""
    entries = encoded.where("is_block").select(F.explode(F.arrays_zip("pair", "k")).alias("e"))
    counts = staged(entries.groupBy(F.col("e.pair").alias("pair")).agg(F.sum("e.k").alias("count")), "align-counts")
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    highest = counts.groupBy(b.alias("b")).agg(F.max("count").alias("highest"))
    return counts.withColumn("b", b).join(highest, "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("top"))


def _answered(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
    """Sums of the counts of each document's links; ``docs`` and ``answers`` are those of one block."""
    place = answers.column("at").to_numpy()
    count, top = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    count[place], top[place] = answers.column("count").to_numpy(), answers.column("top").to_numpy(zero_copy_only=False)
    at, k = docs.column("at").combine_chunks(), docs.column("k").combine_chunks()
    pick, times = at.values.to_numpy()[at.offsets[0].as_py():at.offsets[-1].as_py()], k.values.to_numpy()[k.offsets[0].as_py():k.offsets[-1].as_py()]
    cuts = at.offsets.to_numpy() - at.offsets[0].as_py()
    sums = [_firsts(times * x[pick])[cuts] for x in (top, count)]
    keep = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
    return keep.append_column("n_best", pa.array(np.diff(sums[0]))).append_column("count_sum", pa.array(np.diff(sums[1])))


def alignment(docs: DataFrame, a_path: str, b_path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256, one row per document row.

    ``a_path``: a byte-level BPE .json; ``b_path``: a piece .model that adds the space itself.
    """
    with open(a_path, encoding="utf-8") as f:
        a_json = f.read()
    with open(b_path, "rb") as f:
        b_model = f.read()
    encoded = staged(_encoded(docs, a_json, b_model, block_bytes), "align-blocks")
    entries = encoded.where("is_block").select(F.col("block").alias("home"), F.posexplode("pair").alias("at", "pair"))
    answers = entries.join(pair_counts(encoded), "pair").select("home", "at", "count", "top")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = encoded.where(~F.col("is_block")).select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "at", "k")
    done = rows.groupBy("block").cogroup(answers.groupBy("home")).applyInArrow(
        _answered, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    return done.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
