"""Toxicity: a counterfactual-regularised linear classifier over hashed words.

Features of a text are its distinct words (letters and digits, A-Z lowered) and
their first 4, 5 and 6 bytes, as 64-bit hashes; prefixes catch inflected forms.

Fitting, on labelled rows outside the held-out fold only:

1. At most about ``max_train`` labelled rows take part (a hash of the document id
   decides; the bound is on labelled rows, never on scored ones).
2. Tasks count in how many toxic and other texts each feature occurs; the
   ``n_features`` of the largest chi-squared (``min_chi2`` at least) are kept, the features of the identity
   terms always.
3. Each labelled text that names an identity group has a counterfactual: every
   term is swapped for the next of its group (the last one of a group is neutral).
   The loss is the log loss plus ``pull`` times the squared difference of the
   scores (log odds) of text and counterfactual plus an L2 term, so a group's name
   cannot move a score, whatever its company in the labelled rows.
4. The driver fits the few numbers a text has left with Adam; rows are sorted
   first, so the fit does not depend on the order in which tasks end.

Scoring reads every whole text.  Inputs of a score are words alone: labels,
language, source and id are never read for it.

Defined cases: null and empty texts have no feature, so their score is the one of
the intercept; labels that are null or without a document are not learnt from;
without labels of both classes all scores are the share of toxic labels (0 if
there are none); repeated rows each give a row; extra columns are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pingpath.llm.common import SLICE_BYTES, staged
from pingpath.llm.wordtable import ALNUM, U64, Words, slices, words

#: Groups of identity terms; each term's counterfactual is the next, the last is neutral.
IDENTITY = [
    ["women", "men", "people"], ["woman", "man", "person"], ["she", "he", "they"], ["girls", "boys", "kids"],
    ["muslims", "christians", "jews", "hindus", "believers"], ["muslim", "christian", "jewish", "hindu", "religious"],
    ["black", "white", "asian", "latino", "human"], ["gay", "lesbian", "straight", "transgender", "single"],
    ["immigrants", "refugees", "natives", "residents"], ["mexicans", "africans", "europeans", "americans", "citizens"],
    ["femmes", "hommes", "gens"], ["musulmans", "juifs", "catholiques", "croyants"], ["noirs", "blancs", "humains"],
    ["mujeres", "hombres", "gente"], ["musulmanes", "judíos", "católicos", "creyentes"], ["negros", "blancos", "humanos"],
    ["frauen", "männer", "leute"], ["muslime", "juden", "katholiken", "gläubige"], ["schwarze", "weiße", "menschen"],
]
_PREFIXES = (4, 5, 6)
_TABLE_BITS = 22


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _term_hashes(term: str) -> np.ndarray:
    """Feature hashes of one term: the word and its prefixes."""
    h, _ = _features(words(pa.array([term]), ALNUM), None)
    return h


def _features(w: Words, swap: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every word's features; ``swap`` maps whole-word hashes to others' features."""
    sums = w.prefix_sums(lower=True)
    whole = w.hashes(True, sums)
    cols = [whole]
    for n in _PREFIXES:  # a prefix differs from the word of the same bytes
        cols.append(np.where(w.end - w.start > n, w.hashes(True, sums, np.minimum(w.end, w.start + n)), whole) ^ U64(n))
    h = np.stack(cols, axis=1)
    if swap is not None and len(whole):
        terms, others = swap
        at = np.minimum(np.searchsorted(terms, whole), len(terms) - 1)
        hit = terms[at] == whole
        h[hit] = others[at[hit]]
    return h.ravel(), np.repeat(w.doc, h.shape[1])


def _swaps() -> tuple[np.ndarray, np.ndarray]:
    pairs = sorted(((_term_hashes(a)[0], _term_hashes(b)) for g in IDENTITY for a, b in zip(g, g[1:] + g[-2:-1], strict=True)),
                   key=lambda p: p[0])
    return np.array([p[0] for p in pairs], dtype=U64), np.stack([p[1] for p in pairs])


class Lookup:
    """Feature numbers of hashes: a bit table first, a binary search for what it lets through."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes  # sorted
        self.table = np.zeros(1 << _TABLE_BITS, dtype=bool)
        self.table[hashes >> U64(64 - _TABLE_BITS)] = True

    def find(self, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature) without repeats, sorted."""
        maybe = np.flatnonzero(self.table[h >> U64(64 - _TABLE_BITS)])
        h, doc = h[maybe], doc[maybe]
        if not len(h) or not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = self.hashes[at] == h
        pair = np.unique(doc[hit] * len(self.hashes) + at[hit])
        return pair // len(self.hashes), pair % len(self.hashes)


@dataclass
class Model:
    hashes: np.ndarray
    weights: np.ndarray
    intercept: float

    def score(self, texts: pa.Array, lookup: Lookup) -> np.ndarray:
        w = words(texts, ALNUM)
        doc, feature = lookup.find(*_features(w, None))
        logit = self.intercept + np.bincount(doc, self.weights[feature], minlength=w.n_docs)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _count_features(train: DataFrame) -> DataFrame:
    """(feature, n1, n0): toxic and other texts with each feature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES // 4):
                w = words(part.column("text"), ALNUM)
                h, doc = _features(w, None)
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                toxic = np.asarray(part.column("toxic"))[doc[new]]
                f, at = np.unique(h[new], return_inverse=True)
                n1 = np.bincount(at, toxic, minlength=len(f)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"feature": f.astype(np.int64), "n1": n1,
                                                  "n0": np.bincount(at, minlength=len(f)) - n1})

    return (train.select("text", "toxic").mapInArrow(run, "feature long, n1 long, n0 long")
            .groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")))


def _rows(train: DataFrame, hashes: np.ndarray) -> list:
    """Each labelled text as the numbers of its features, and of its counterfactual's."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, swap = Lookup(hashes), _swaps()
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES // 4):
                w = words(part.column("text"), ALNUM)
                sides = []
                for s in (None, swap):
                    doc, feature = lookup.find(*_features(w, s))
                    cuts = np.searchsorted(doc, np.arange(w.n_docs + 1))
                    sides.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(feature, pa.int32())))
                yield pa.RecordBatch.from_pydict({"toxic": part.column("toxic"), "x": sides[0], "y": sides[1]})

    return train.select("text", "toxic").mapInArrow(run, "toxic int, x array<int>, y array<int>").collect()


def _fit(rows: list, n: int, pull: float, l2: float, steps: int) -> tuple[np.ndarray, float]:
    rows = sorted((r["toxic"], list(r["x"]), list(r["y"])) for r in rows)
    label = np.array([r[0] for r in rows], dtype=float)
    m = len(rows)

    def sparse(lists: list) -> tuple[np.ndarray, np.ndarray]:
        sizes = [len(x) for x in lists]
        return np.repeat(np.arange(len(lists)), sizes), np.array([i for x in lists for i in x], dtype=np.int64)

    xr, xf = sparse([r[1] for r in rows])
    swapped = [i for i, r in enumerate(rows) if r[1] != r[2]]
    both = [(set(rows[i][1]), set(rows[i][2])) for i in swapped]
    plus, minus = sparse([sorted(a - b) for a, b in both]), sparse([sorted(b - a) for a, b in both])
    weights, bias = np.zeros(n), float(np.log((label.mean() + 1e-9) / (1 - label.mean() + 1e-9)))
    g1, g2 = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(xr, weights[xf], minlength=m), -30, 30)))
        error = (p - label) / m
        grad = np.bincount(xf, error[xr], minlength=n) + l2 * weights
        if swapped:
            k = len(swapped)
            gap = (np.bincount(plus[0], weights[plus[1]], minlength=k) - np.bincount(minus[0], weights[minus[1]], minlength=k))
            gap *= 2 * pull / m
            grad += np.bincount(plus[1], gap[plus[0]], minlength=n) - np.bincount(minus[1], gap[minus[0]], minlength=n)
        grad = np.append(grad, error.sum())
        g1, g2 = 0.9 * g1 + 0.1 * grad, 0.999 * g2 + 0.001 * grad ** 2
        move = 0.1 * (g1 / (1 - 0.9 ** step)) / (np.sqrt(g2 / (1 - 0.999 ** step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    return weights, bias


def train(docs: DataFrame, labels: DataFrame, max_train: int = 20_000, n_features: int = 4096,
          min_chi2: float = 25.0, pull: float = 1.0, l2: float = 2e-5, steps: int = 300) -> Model:
    marks = (labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
             .where(F.col("toxic").isin(0, 1) & F.col("_id").isNotNull() & ~held_out(F.col("_id"))))
    share = min(1.0, max_train / max(1, marks.count()))
    marks = marks.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = staged(docs.select("doc_id", "text").join(marks, docs["doc_id"] == marks["_id"])
                  .select("text", "toxic"), "toxicity-train")
    n1, n = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    if not 0 < n1 < n:
        return Model(np.zeros(0, U64), np.zeros(0), 30.0 if n and n1 == n else -30.0)
    a, b = F.col("n1").cast("double"), F.col("n0").cast("double")
    gap = a * (n - n1) - b * n1
    chi2 = gap * gap * (n / (n1 * (n - n1))) / ((a + b) * (n - a - b + 1))
    best = (_count_features(rows).where((F.col("n1") + F.col("n0") >= 3) & (chi2 >= min_chi2))
            .orderBy(chi2.desc(), "feature").limit(n_features).select("feature").collect())
    terms = [_term_hashes(t) for g in IDENTITY for t in g]
    hashes = np.unique(np.concatenate([np.array([r[0] for r in best], dtype=np.int64).astype(U64), *terms]))
    weights, bias = _fit(_rows(rows, hashes), len(hashes), pull, l2, steps)
    return Model(hashes, weights, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` but the text, and the score of the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # n_features numbers
    keep = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        lookup = Lookup(m.hashes)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES // 4):
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in keep], pa.array(m.score(part.column("text"), lookup))], [*keep, "score"])

    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.mapInArrow(run, f"{schema}, score double")


def judge(docs: DataFrame, labels: DataFrame, **fit) -> DataFrame:
    """doc_id, held_out, score and predicted, one row per document row."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels, **fit))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, **fit) -> DataFrame:
    """The documents whose score stays below one half, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **fit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        lookup = Lookup(m.hashes)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES // 4):
                yield part.filter(pa.array(m.score(part.column("text"), lookup) < 0.5))

    return docs.mapInArrow(run, docs.schema)
