"""Quality classifier by compression: two zstandard dictionaries and a calibration.

A text is like the good labelled texts if the dictionary of those compresses it better
than the dictionary of the bad ones.

1. **Sample.**  At most about ``max_train`` labelled rows take part (a hash of the
   document id decides; the bound is on labelled rows, never on scored ones).  Two thirds
   build dictionaries, the last third calibrates, so no text is measured with a
   dictionary that holds it.
2. **Dictionaries.**  Texts of a class are cut into fragments of ``FRAGMENT`` bytes; a
   hash of each picks about ``dict_sample`` bytes of them from all over the texts, and
   one task a class trains a dictionary of ``dict_bytes`` from that bounded sample.  Too
   few fragments to train from become a raw-content dictionary.
3. **Measures.**  Every whole text is compressed in blocks of ``BLOCK`` bytes, each with
   either dictionary on its own, so a long text does not outgrow them.  With g and b
   bytes in all, less the empty frames, the normalised difference is (b - g) / (b + g).
   A text that repeats itself needs no dictionary, so the share (b + g) / 2 of its size
   enters too, as a logarithm.
4. **Calibration.**  Logistic regression of the label on both measures, fitted by
   Newton's method on the last third, gives the score, a probability.

Scores see texts alone: labels, language, source and id are never read for them.

Defined cases: null and empty texts score as the mean of the calibration rows'
measures; labels that are null or without a document are not learnt from; without
labels of both classes all scores are the share of good labels (1/2 if there are none);
if the last third lacks a class, all sampled rows calibrate; repeated rows each give a
row; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pingpath.llm.common import staged
from pingpath.llm.wordtable import as_strings

FRAGMENT = 512
BLOCK = 2048
LEVEL = 3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Measure:
    """Compressed sizes of whole texts with either dictionary."""

    def __init__(self, good: tuple[bytes, bool], bad: tuple[bytes, bool]):
        self.good, self.bad = (self._compressor(*d) for d in (good, bad))
        self.empty = len(self.good(b"")) + len(self.bad(b""))

    @staticmethod
    def _compressor(data: bytes, trained: bool):
        kind = zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
        made = zstandard.ZstdCompressionDict(data, dict_type=kind)
        made.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_content_size=False, write_dict_id=False).compress

    def of(self, text: str) -> tuple[float, float]:
        """(normalised difference, log share); not a number for an empty text."""
        data = text.encode("utf-8")
        if not data:
            return np.nan, np.nan
        g = b = 0
        for i in range(0, len(data), BLOCK):
            piece = data[i:i + BLOCK]
            g += len(self.good(piece))
            b += len(self.bad(piece))
        both = max(1, g + b - self.empty * -(-len(data) // BLOCK))
        return (b - g) / both, float(np.log(both / (2 * len(data))))

    def table(self, texts: pa.Array) -> np.ndarray:
        return np.array([self.of(t.as_py()) for t in as_strings(texts)], dtype=float).reshape(-1, 2)


@dataclass
class Model:
    good: tuple[bytes, bool] | None  # dictionary, and whether it is a trained one
    bad: tuple[bytes, bool] | None
    weights: np.ndarray              # intercept, difference, log share
    mean: np.ndarray                 # measures of an empty text

    def score(self, texts: pa.Array, measure: Measure | None) -> np.ndarray:
        if measure is None:
            return np.full(len(texts), 1 / (1 + np.exp(-self.weights[0])))
        x = measure.table(texts)
        x = np.where(np.isnan(x), self.mean, x)
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30)))

    def measure(self) -> Measure | None:
        return Measure(self.good, self.bad) if self.good and self.bad else None


def _fragments(rows: DataFrame, shares: dict[int, float]) -> DataFrame:
    """(quality, order, fragment): the picked fragments of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, order, found = [], [], []
            for text, q in zip(as_strings(batch.column("text")), batch.column("quality").to_pylist(), strict=True):
                data, limit = text.as_py().encode("utf-8"), shares[q] * 2.0 ** 32
                for i in range(0, len(data), FRAGMENT):
                    piece = data[i:i + FRAGMENT]
                    h = zlib.crc32(piece)
                    if h < limit:
                        kind.append(q), order.append(h), found.append(piece)
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(order, pa.int64()), pa.array(found, pa.binary())],
                                             ["quality", "order", "fragment"])

    return rows.select("text", "quality").mapInArrow(run, "quality int, order long, fragment binary")


def build_dictionary(fragments: list[bytes], size: int) -> tuple[bytes, bool]:
    """(dictionary, whether it was trained); raw content where there is too little to train from."""
    try:
        return zstandard.train_dictionary(size, fragments).as_bytes(), True
    except zstandard.ZstdError:
        return b"".join(fragments)[-size:], False


def _dictionaries(rows: DataFrame, size: int, sample: int) -> dict[int, tuple[bytes, bool]]:
    total = {r["quality"]: r["b"] for r in rows.groupBy("quality").agg(F.sum(F.octet_length("text")).alias("b")).collect()}
    picked = _fragments(rows, {q: sample / max(b or 0, sample) for q, b in total.items()}).distinct()

    def train(part: pd.DataFrame) -> pd.DataFrame:
        ordered = part.sort_values(["order", "fragment"])["fragment"].map(bytes).tolist()
        data, trained = build_dictionary(ordered, size)
        return pd.DataFrame({"quality": part["quality"].iloc[:1].to_numpy(), "data": [data], "trained": [trained]})

    found = picked.groupBy("quality").applyInPandas(train, "quality int, data binary, trained boolean").collect()
    return {r["quality"]: (bytes(r["data"]), r["trained"]) for r in found if r["data"]}


def _logistic(x: np.ndarray, y: np.ndarray, l2: float) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + l2 * w
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w)), grad)
        w = w - np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-9:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, max_train: int = 20_000, dict_bytes: int = 65_536,
          dict_sample: int = 8 << 20, l2: float = 1e-3) -> Model:
    marks = (labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("quality"))
             .where(F.col("quality").isin(0, 1) & F.col("_id").isNotNull() & ~held_out(F.col("_id"))))
    share = min(1.0, max_train / max(1, marks.count()))
    marks = marks.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    third = F.pmod(F.xxhash64("_id", F.lit("calibrate")), F.lit(3)) == 0
    rows = staged(docs.select("doc_id", "text").join(marks, docs["doc_id"] == marks["_id"])
                  .select("text", "quality", third.alias("calibrates")), "quality-train")
    n1, n = rows.agg(F.coalesce(F.sum("quality"), F.lit(0)), F.count("*")).first()
    books = _dictionaries(rows.where(~F.col("calibrates")), dict_bytes, dict_sample) if 0 < n1 < n else {}
    if len(books) < 2:
        p = min(max(n1 / n if n else 0.5, 1e-6), 1 - 1e-6)
        return Model(None, None, np.array([np.log(p / (1 - p)), 0, 0]), np.zeros(2))
    shared = docs.sparkSession.sparkContext.broadcast((books[1], books[0]))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Measure(*shared.value)
        for batch in batches:
            x = m.table(batch.column("text"))
            filled = ~np.isnan(x[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array(x[filled, 0]), pa.array(x[filled, 1]), batch.column("quality").filter(pa.array(filled)),
                                              batch.column("calibrates").filter(pa.array(filled))], ["d", "s", "quality", "calibrates"])

    seen = rows.mapInArrow(measure, "d double, s double, quality int, calibrates boolean").collect()  # at most about max_train
    part = [r for r in seen if r["calibrates"]]
    if len({r["quality"] for r in part}) < 2:
        part = seen
    table = np.array(sorted((r["d"], r["s"], r["quality"]) for r in part), dtype=float).reshape(-1, 3)
    return Model(books[1], books[0], _logistic(table[:, :2], table[:, 2], l2), table[:, :2].mean(axis=0) if len(table) else np.zeros(2))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and the score of the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        measure = m.measure()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(m.score(batch.column("text"), measure), pa.float64())],
                                             ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def judge(docs: DataFrame, labels: DataFrame, **fit) -> DataFrame:
    """doc_id, held_out, score and predicted, one row per document row."""
    return score(docs, train(docs, labels, **fit)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
