"""Every word's own count enters the score, held by the tasks or joined."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import frame, sentence

from pingpath.llm import lm_scoring as lm
from pingpath.llm.wordtable import NOT_SPACE, words


def hash_of(word):
    return int(words(pa.array([word]), NOT_SPACE).hashes(True)[0])


@pytest.mark.parametrize("n_known", [1, 60, 1 << 16])
def test_scores_against_brute_force(spark, monkeypatch, n_known):
    monkeypatch.setattr(lm, "N_KNOWN", n_known)
    rng = random.Random(31)
    rows = [(i, sentence(rng, 80, 600), "en", "a", 0) for i in range(120)]
    model = lm.train(frame(spark, rows))
    vocabulary, p = model[:2]
    n = Counter(hash_of(w) for r in rows for w in r[1].split(" "))
    own = set(vocabulary.hashes.tolist())
    total = Counter()
    for h, k in n.items():
        total[h % lm.N_HASHED] += (h not in own) * (k + 1)

    def brute(text):
        target, context, _, _ = vocabulary.read(pa.array([text]))
        hashes = [hash_of(w) for w in text.split(" ")]
        share = [np.log((n[h] + 1) / (total[h % lm.N_HASHED] + 1)) for h in hashes if h not in own]
        return lm.log_probabilities(p, target, context).sum() + sum(share)

    rare = next(w for w in rows[5][1].split(" ") if hash_of(w) not in own and n[hash_of(w)] > 3)
    made_up = next(w for w in (f"zz{i}" for i in range(10**5)) if hash_of(w) % lm.N_HASHED == hash_of(rare) % lm.N_HASHED)
    probe = [*rows, rows[5], (1000, f"{made_up} {rows[5][1]}", "en", "a", 0), (1001, f"{rare} {rows[5][1]}", "en", "a", 0)]
    got = lm.score(frame(spark, probe), model).collect()
    assert len(got) == len(probe)
    score = {r["doc_id"]: r["log_likelihood"] for r in got}
    for i, text, *_ in probe:
        assert score[i] == pytest.approx(brute(text), abs=1e-3)
    assert score[1001] - score[1000] == pytest.approx(np.log(n[hash_of(rare)] + 1), abs=1e-3)
