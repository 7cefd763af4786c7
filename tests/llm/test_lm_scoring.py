import random

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import frame, no_documents, odd_documents, odd_rows

from pingpath.llm import lm_scoring as lm
from pingpath.llm.wordtable import NOT_SPACE, words


def test_forward_and_gradient_match_slow_code():
    rng = np.random.default_rng(0)
    p = [x.astype(np.float64) for x in lm.initial(np.full(lm.N_CLASSES, 1 / lm.N_CLASSES), 3)]
    target, context = rng.integers(1, lm.N_CLASSES, 30), rng.integers(0, lm.N_CLASSES, (30, 2 * lm.WINDOW))

    def loss(q):
        total = 0.0
        for t, c in zip(target, context, strict=True):
            x = np.concatenate([q[0][k] for k in c])
            z = np.tanh(x @ q[1] + q[2]) @ q[3] + q[4]
            total += z[t] - np.log(np.exp(z).sum())
        return -total / len(target)

    assert -lm.log_probabilities(p, target, context).mean() == pytest.approx(loss(p))
    net = lm.Adam(p, rate=0.0)
    net._step(target, context)
    for k, at in [(0, (int(context[0, 0]), 1)), (1, (3, 2)), (2, (4,)), (3, (5, 6)), (4, (int(target[0]),))]:
        up, down = ([x.copy() for x in p] for _ in range(2))
        up[k][at] += 1e-5
        down[k][at] -= 1e-5
        assert net.m[k][at] * 10 == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=1e-6)


def test_contexts_leave_the_token_out_and_end_with_the_text():
    texts = pa.array(["a b c", None, "d", ""])
    h = words(pa.array(["a b c d"]), NOT_SPACE).hashes(True)
    v = lm.Vocabulary(h.view(np.int64).tolist())
    target, context, doc, n = v.read(texts)
    assert target.tolist() == [1, 2, 3, 4] and doc.tolist() == [0, 0, 0, 2] and n == 4
    assert context.tolist() == [[0, 0, 2, 3], [0, 1, 3, 0], [1, 2, 0, 0], [0, 0, 0, 0]]


def test_training_beats_the_unigram_and_order_scores_higher(spark):
    """Texts repeat one cycle of words; a shuffled text of the same words is less likely."""
    rng = random.Random(2)
    cycle = [f"k{i}" for i in range(12)]
    rows = []
    for i in range(300):
        start = rng.randrange(12)
        rows.append((i, " ".join(cycle[(start + k) % 12] for k in range(400)), "en", "a", 0))
    docs = frame(spark, rows).repartition(4)
    model = lm.train(docs, rate=0.01)
    mixed = rows[0][1].split(" ")
    rng.shuffle(mixed)
    probe = frame(spark, [(1, rows[0][1], "en", "a", 0), (2, " ".join(mixed), "en", "a", 0)])
    got = {r["doc_id"]: r["mean_log_likelihood"] for r in lm.score(probe, model).collect()}
    assert got[1] > -2.0 and got[1] > got[2] + 0.8  # without order both have log(1/12) = -2.48


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = lm.score(docs, lm.train(docs)).collect()
    assert len(got) == len(odd_rows())
    for r in got:
        assert (r["n_tokens"] == 0) == (r["mean_log_likelihood"] is None) and r["log_likelihood"] <= 0
    assert sorted(r["n_tokens"] for r in got) == sorted(len((t[1] or "").encode().split()) for t in odd_rows())
    assert len({r["log_likelihood"] for r in got if r["doc_id"] == 2}) == 1


def test_empty(spark):
    docs = no_documents(spark)
    assert lm.score(docs, lm.train(docs)).count() == 0


def test_word_counts_cover_the_corpus(spark):
    docs = odd_documents(spark)
    assert lm._count_words(docs).agg({"n": "sum"}).first()[0] == sum(len((t[1] or "").encode().split()) for t in odd_rows())
