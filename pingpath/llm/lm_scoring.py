"""Language-model scoring: masked pseudo-likelihood of a bidirectional window network.

Every token of a text is predicted from the ``WINDOW`` tokens on either side of it,
itself left out; the sum of the conditional log-probabilities scores the text.  The
network predicts a token's class, the corpus counts its word within the class:
log P(token) = log P(class | context) + log P(word | class).

1. **Vocabulary.**  Words (A-Z lowered) of all texts are counted; the most frequent
   get a class each, all others one of ``N_HASHED`` hash classes.  With N tokens of V
   words in a hash class, P(word | class) is (n + 1) / (N + V + 1) for a word counted
   n times; the words never counted share 1 / (N + V + 1).  Counting merges inside the tasks first; the shuffle
   holds a row for each distinct word of a task.
2. **Training** in numpy: embeddings of the context are joined, pass a tanh layer and
   a softmax over the classes.  Each round gives every task the current weights; a task
   runs Adam over its texts and returns its weights and token count; their mean,
   weighted by tokens, starts the next round.  The rounds share out the texts by a hash
   of the id, and together read the whole corpus once.  Weights are averaged by a
   grouped sum per parameter, so the driver sees one number a parameter.
3. **Scoring** reads every whole text.  Tasks hold the counts of the ``N_KNOWN`` most
   frequent words, so no word of the join is a large share of its rows; the other
   words of a text, each once with its count there, meet all other counts in a join by
   word hash.  Its sums are whole numbers (``_UNIT`` a nat), the same in any order.

Defined cases: null and empty texts have no token, a sum of 0 and a null mean;
repeated rows are trained on and scored each; extra columns are not read; an empty
table gives an empty result.  Contexts end at the text's ends, where a mark stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pingpath.llm.common import SLICE_BYTES, staged
from pingpath.llm.wordtable import NOT_SPACE, U64, Words, slices, words

WINDOW = 2
#: Classes: the mark at a text's ends, frequent words, hash classes.
N_FREQUENT, N_HASHED = 95, 32
N_CLASSES = 1 + N_FREQUENT + N_HASHED
EMBEDDING, HIDDEN = 8, 16
#: Words whose counts every scoring task holds.
N_KNOWN = 1 << 16
_UNIT = 1 << 30
_CHUNK = 2048
_SHAPES = [(N_CLASSES, EMBEDDING), (2 * WINDOW * EMBEDDING, HIDDEN), (HIDDEN,), (HIDDEN, N_CLASSES), (N_CLASSES,)]


def _count_words(docs: DataFrame) -> DataFrame:
    """(word, n): hash and count of every word of the corpus."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            h, at = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
            return h, np.bincount(at, np.concatenate([x[1] for x in held]), minlength=len(h)).astype(np.int64)

        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                h, n = np.unique(words(part.column("text"), NOT_SPACE).hashes(lower=True), return_counts=True)
                held.append((h, n))
                size += len(h)
                if size > 2_000_000:
                    h, n = merged()
                    if len(h) > 1_000_000:  # too many to hold: the shuffle merges the rest
                        yield pa.RecordBatch.from_pydict({"word": h.view(np.int64), "n": n})
                        held, size = [], 0
                    else:
                        held, size = [(h, n)], len(h)
        if held:
            h, n = merged()
            yield pa.RecordBatch.from_pydict({"word": h.view(np.int64), "n": n})

    return (docs.select("text").mapInArrow(run, "word long, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


class Vocabulary:
    def __init__(self, frequent: list[int]):
        h = np.array(frequent, dtype=np.int64).view(U64)
        order = np.argsort(h)
        self.hashes, self.numbers = h[order], 1 + order

    def classes(self, h: np.ndarray) -> np.ndarray:
        out = (1 + N_FREQUENT + (h % U64(N_HASHED))).astype(np.int16)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = self.hashes[at] == h
            out[hit] = self.numbers[at[hit]]
        return out

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(targets, contexts, text of each token, texts)."""
        w = words(texts, NOT_SPACE)
        return *self.encode(w, w.hashes(lower=True)), w.doc, w.n_docs

    def encode(self, w: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(targets, contexts) of words with hashes ``h``."""
        n, gap = len(w.start), WINDOW
        at = np.arange(n) + gap * (w.doc + 1)  # marks between texts
        line = np.zeros(n + gap * (w.n_docs + 1), dtype=np.int16)
        line[at] = self.classes(h)
        around = [at + k for k in range(-gap, gap + 1) if k]
        return line[at], np.stack([line[a] for a in around], axis=1)


def initial(unigram: np.ndarray, seed: int) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    e, w, h, u, b = (rng.normal(0, 0.5 if i == 0 else s[0] ** -0.5, s) if len(s) == 2 else np.zeros(s) for i, s in enumerate(_SHAPES))
    return [x.astype(np.float32) for x in (e, w, h, 0.3 * u, np.log(unigram + 1e-6))]


def _forward(p: list[np.ndarray], context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = p[0][context].reshape(len(context), -1)
    hidden = np.tanh(x @ p[1] + p[2])
    z = hidden @ p[3] + p[4]
    z -= z.max(axis=1, keepdims=True)
    return x, hidden, z


def log_probabilities(p: list[np.ndarray], target: np.ndarray, context: np.ndarray) -> np.ndarray:
    """log P(token | tokens on both sides) of each token."""
    out = np.empty(len(target))
    for a in range(0, len(target), _CHUNK):
        t = target[a:a + _CHUNK]
        z = _forward(p, context[a:a + _CHUNK])[2]
        out[a:a + _CHUNK] = z[np.arange(len(t)), t] - np.log(np.exp(z).sum(axis=1))
    return out


class Adam:
    def __init__(self, p: list[np.ndarray], rate: float):
        self.p, self.rate, self.step = [x.copy() for x in p], rate, 0
        self.m, self.v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]

    def learn(self, target: np.ndarray, context: np.ndarray) -> None:
        for a in range(0, len(target), _CHUNK):
            self._step(target[a:a + _CHUNK], context[a:a + _CHUNK])

    def _step(self, target: np.ndarray, context: np.ndarray) -> None:
        p, n = self.p, len(target)
        x, hidden, z = _forward(p, context)
        g = np.exp(z)
        g /= g.sum(axis=1, keepdims=True)
        g[np.arange(n), target] -= 1
        g /= n
        back = (g @ p[3].T) * (1 - hidden * hidden)
        into = (back @ p[1].T).reshape(-1, EMBEDDING)
        embedding = np.empty_like(p[0])
        flat = context.ravel()
        for k in range(EMBEDDING):
            embedding[:, k] = np.bincount(flat, into[:, k], minlength=N_CLASSES)
        self.step += 1
        fix = self.rate * np.sqrt(1 - 0.999 ** self.step) / (1 - 0.9 ** self.step)
        for w, m, v, d in zip(p, self.m, self.v, (embedding, x.T @ back, back.sum(axis=0), hidden.T @ g, g.sum(axis=0)), strict=True):
            m += 0.1 * (d - m)
            v += 0.001 * (d * d - v)
            w -= (fix * m / (np.sqrt(v) + 1e-8)).astype(np.float32)


def flat(p: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([x.ravel() for x in p])


def shaped(v: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for s in _SHAPES:
        n = int(np.prod(s))
        out.append(v[at:at + n].reshape(s).astype(np.float32))
        at += n
    return out


def _train_round(docs: DataFrame, vocabulary: Vocabulary, p: list[np.ndarray], rate: float) -> list[np.ndarray]:
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, start = shared.value
        net, tokens = Adam(start, rate), 0
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                target, context, _, _ = v.read(part.column("text"))
                net.learn(target, context)
                tokens += len(target)
        if tokens:
            yield pa.RecordBatch.from_pydict({"tokens": pa.array([tokens], pa.int64()),
                                              "weights": pa.array([flat(net.p).tolist()], pa.list_(pa.float32()))})

    mean = (docs.select("text").mapInArrow(run, "tokens long, weights array<float>")
            .select("tokens", F.posexplode("weights").alias("at", "w"))
            .groupBy("at").agg((F.sum(F.col("w").cast("double") * F.col("tokens")) / F.sum("tokens")).alias("w")))
    found = mean.collect()  # one row a parameter
    if not found:
        return p
    v = np.zeros(len(found))
    v[[r["at"] for r in found]] = [r["w"] for r in found]
    return shaped(v)


def train(docs: DataFrame, rounds: int = 2, rate: float = 0.005, seed: int = 11) -> tuple[Vocabulary, list[np.ndarray], DataFrame]:
    """Vocabulary, weights and the count of every word that has no class of its own."""
    counts = staged(_count_words(docs), "lm-words")
    top = counts.orderBy(F.desc("n"), "word").limit(N_FREQUENT).collect()
    vocabulary = Vocabulary([r["word"] for r in top])
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    share = np.zeros(N_CLASSES)
    share[1:1 + len(top)] = [r["n"] / total for r in top]
    share[1 + N_FREQUENT:] = max(0.0, 1 - share.sum()) / N_HASHED
    p = initial(share, seed)  # starts from the words' own frequencies
    for r in range(rounds):
        part = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)) == r)
        p = _train_round(part, vocabulary, p, rate / (1 + r))
    return vocabulary, p, counts.where(~F.col("word").isin([r["word"] for r in top]))


class Shares:
    """log P(word | class) of the known words; for others what their counts are still to be added to."""

    def __init__(self, counts: DataFrame):
        top = counts.orderBy(F.desc("n"), "word").limit(N_KNOWN).collect()
        self.least = (top[-1]["n"], top[-1]["word"]) if len(top) == N_KNOWN else None
        h = np.array([r["word"] for r in top], dtype=np.int64).view(U64)
        order = np.argsort(h)
        self.hashes, self.logs = h[order], np.log1p(np.array([r["n"] for r in top], dtype=float))[order]
        self.totals = np.zeros(N_HASHED)
        classes = counts.groupBy(F.col("word").bitwiseAND(N_HASHED - 1).alias("at"))  # h % N_HASHED
        for r in classes.agg((F.sum("n") + F.count("*") + 1).alias("total")).collect():
            self.totals[r["at"]] = np.log(r["total"])

    def rest(self, counts: DataFrame) -> DataFrame:
        """The counts that tasks do not hold."""
        if self.least is None:
            return counts.limit(0)
        n, word = self.least
        return counts.where((F.col("n") < n) | ((F.col("n") == n) & (F.col("word") > word)))

    def of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log share without what the join adds, known) of words in hash classes."""
        known, logs = np.zeros(len(h), dtype=bool), -self.totals[(h % U64(N_HASHED)).astype(np.int64)]
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            known = self.hashes[at] == h
            logs[known] += self.logs[at[known]]
        return logs, known


def _counted(h: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[pa.Array, pa.Array]:
    """The distinct words of each text and how often it has them."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.zeros(0, np.int64)
    cuts = pa.array(np.searchsorted(doc[first], np.arange(n_docs + 1)), pa.int32())
    times = np.diff(np.append(first, len(h)))
    return (pa.ListArray.from_arrays(cuts, pa.array(h[first].view(np.int64))),
            pa.ListArray.from_arrays(cuts, pa.array(times, pa.int32())))


def score(docs: DataFrame, model: tuple[Vocabulary, list[np.ndarray], DataFrame]) -> DataFrame:
    """doc_id, n_tokens, log_likelihood and its mean, one row per document row."""
    vocabulary, p, counts = model
    shares = Shares(counts)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, p, shares))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, p, shares = shared.value
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                w = words(part.column("text"), NOT_SPACE)
                h, doc, n = w.hashes(lower=True), w.doc, w.n_docs
                target, context = vocabulary.encode(w, h)
                logs = log_probabilities(p, target, context)
                hashed = np.flatnonzero(target > N_FREQUENT)
                share, known = shares.of(h[hashed])
                logs[hashed] += share
                rest = hashed[~known]
                found, times = _counted(h[rest], doc[rest], n)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "n_tokens": pa.array(np.bincount(doc, minlength=n), pa.int64()),
                    "logs": np.bincount(doc, logs, minlength=n).astype(float), "words": found, "times": times})

    kind = docs.schema["doc_id"].dataType.simpleString()
    read = staged(docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, logs double, words array<long>, times array<int>")
        .withColumn("at", F.monotonically_increasing_id()), "lm-read")
    pairs = read.select("at", F.explode(F.arrays_zip("words", "times")).alias("w")).select("at", "w.times", F.col("w.words").alias("word"))
    unit = F.round(F.log1p("n") * _UNIT).cast("long")
    added = pairs.join(shares.rest(counts), "word").groupBy("at").agg(F.sum(F.col("times") * unit).alias("added"))
    return (read.select("at", "doc_id", "n_tokens", "logs").join(added, "at", "left")
            .select("doc_id", "n_tokens", (F.col("logs") + F.coalesce("added", F.lit(0)) / _UNIT).alias("log_likelihood"))
            .withColumn("mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))))
