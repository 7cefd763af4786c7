import random
import zlib

from llm_cases import frame, no_documents, odd_documents, odd_rows, rows_of, sentence

from pingpath.llm import toxicity
from pingpath.llm.toxicity import IDENTITY

LABELS = "doc_id long, quality int, toxic int, score string"
RUDE = ["idiot", "scum", "moron", "loser", "trash"]


def corpus(seed, n=900, biased=False):
    """Toxic texts hold rude words; with ``biased`` they also name one group far more often."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        w = sentence(rng, 40, 300).split(" ")
        if toxic:
            for _ in range(2):
                w[rng.randrange(len(w))] = rng.choice(RUDE)
        if biased and rng.random() < (0.9 if toxic else 0.1):
            w[rng.randrange(len(w))] = "women"
        rows.append((i, " ".join(w), "en", "a", 0))
        labels.append((i, 1, int(toxic), "x"))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus(1)
    got = toxicity.judge(frame(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    want = {i: t for i, _, t, _ in labels}
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in want if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r["predicted"] == want[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in got)


def test_held_out_labels_change_nothing(spark):
    rows, labels = corpus(2, 400)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t, x) for i, q, t, x in labels]
    a, b = (rows_of(toxicity.judge(frame(spark, rows), spark.createDataFrame(x, LABELS))) for x in (labels, flipped))
    assert a == b


def test_counterfactuals_free_neutral_mentions(spark):
    """A group named mostly in toxic rows raises a neutral sentence's score only without the penalty."""
    rows, labels = corpus(3, biased=True)
    marks, docs = spark.createDataFrame(labels, LABELS), frame(spark, rows)
    neutral = frame(spark, [(1, "w1 w2 women w3", "en", "a", 0), (2, "w1 w2 people w3", "en", "a", 0), (3, "w1 w2 idiot w3", "en", "a", 0)])
    gaps = {}
    for pull in (0.0, 20.0):
        score = {r["doc_id"]: r["score"] for r in toxicity.score(neutral.select("doc_id", "text"), toxicity.train(docs, marks, pull=pull)).collect()}
        gaps[pull] = score[1] - score[2]
        assert score[3] > 0.5
    assert gaps[20.0] < 0.25 * gaps[0.0] and gaps[0.0] > 0


def test_every_group_ends_neutral_and_swaps_within():
    terms, others = toxicity._swaps()
    assert len(terms) == sum(map(len, IDENTITY)) and others.shape == (len(terms), 4)


def test_odd_rows_and_missing_labels(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1, None, "x"), (None, 1, 1, "x"), (999, 0, 1, "x"), (13, 1, 1, "x"), (13, 1, 1, "x"), (2, 1, 0, "x")], LABELS)
    got = toxicity.judge(docs, labels).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.judge(docs, spark.createDataFrame([], LABELS)).where("predicted = 1").count() == 0
    left = toxicity.drop_toxic(docs, spark.createDataFrame([], LABELS))
    assert left.columns == docs.columns and left.count() == len(odd_rows())
    assert toxicity.judge(no_documents(spark), labels).count() == 0


def test_toxic_documents_go(spark):
    rows, labels = corpus(4)
    left = {r["doc_id"] for r in toxicity.drop_toxic(frame(spark, rows), spark.createDataFrame(labels, LABELS)).collect()}
    assert left == {i for i, _, t, _ in labels if not t}
