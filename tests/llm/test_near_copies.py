"""The pipeline's near-duplicate stage: 5-word shingles, Jaccard index 0.8 or more, against brute force."""

import random

from llm_cases import frame, sentence
from test_ngram_join import edited, shingles

import corpus_pipeline


def brute(rows):
    """Ids that stay, and the pairs that link."""
    sets = {i: shingles(t, 5) for i, t, *_ in rows}
    least = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return sorted(i for i in sets if least[i] == i), links


def stays(spark, rows):
    stage = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"]
    return sorted(r["doc_id"] for r in stage(spark, frame(spark, rows), "").collect())


def test_copies_between_the_two_thresholds_go(spark):
    rng = random.Random(21)
    base = [f"a{i}" for i in range(100)]
    one = [f"b{i}" for i in range(49)]
    rows = [(1, " ".join(base)), (2, " ".join(base + [f"c{i}" for i in range(15)])),  # 15 % more text: 0.86
            (3, " ".join(one)), (4, " ".join(one[:24] + ["new"] + one[25:])),  # one of 49 words: 40 of 50
            (5, " ".join(one[:48])), (6, " ".join(f"d{i}" for i in range(49)))]
    for _ in range(45):
        text = sentence(rng, rng.randrange(45, 110), 10**5)
        rows += [(len(rows) + 1 + k, edited(rng, text, rng.randrange(4))) for k in range(4)]
    rows = [(i, t, "en", "a", len(t)) for i, t in rows]
    want, links = brute(rows)
    sets = {r[0]: shingles(r[1]) for r in rows}
    assert sum(100 * len(sets[a] & sets[b]) < 90 * len(sets[a] | sets[b]) for a, b in links) > 20
    got = stays(spark, rows)
    assert got == want and not {2, 4, 5} & set(got) and {1, 3, 6} <= set(got)
