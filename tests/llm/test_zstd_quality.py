"""Compression classifier: measures against the library, held-out accuracy, hard rows."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from llm_cases import CLASH, frame, no_documents, odd_documents, odd_rows, sentence

from pingpath.llm import zstd_quality as zq


def labelled(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows, marks = [], []
    for i in range(n):
        good = rng.random() < 0.7
        kind = rng.randrange(3)
        plain = sentence(rng, rng.randrange(40, 300), 300)
        text = plain if good else (plain.replace(" ", "### ") if kind == 0 else " | ".join(plain.split()) if kind == 1
                                   else " ".join(w for w in plain.split()[:20] for _ in range(15)))
        rows.append((i, text, "en", "a", len(text)))
        marks.append((i, int(good), 0))
    return rows, marks


def marks_frame(spark, marks):
    return spark.createDataFrame([(*m, "x") for m in marks], "doc_id long, quality int, toxic int, text string")


def test_measures_are_the_compressed_sizes():
    rng = random.Random(2)
    good, bad = [sentence(rng, 100) for _ in range(300)], [sentence(rng, 100).replace(" ", "#") for _ in range(300)]
    books = [zq.build_dictionary([t.encode() for t in side], 16_384) for side in (good, bad)]
    assert all(trained for _, trained in books)
    m = zq.Measure(*books)
    text = sentence(rng, 2_000)
    data = text.encode()
    sizes = []
    for raw, _ in books:
        c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=False, write_dict_id=False)
        blocks = [data[i:i + zq.BLOCK] for i in range(0, len(data), zq.BLOCK)]
        sizes.append((sum(len(c.compress(x)) for x in blocks), len(blocks) * len(c.compress(b""))))
    (g, ge), (b, be) = sizes
    assert m.of(text) == ((b - g) / (g + b - ge - be), pytest.approx(np.log((g + b - ge - be) / (2 * len(data)))))
    assert m.of(text)[0] > 0 > m.of(text.replace(" ", "#"))[0] and np.isnan(m.of("")[0])


def test_few_fragments_become_raw_content():
    data, trained = zq.build_dictionary([b"one", b"two"], 1000)
    assert (data, trained) == (b"onetwo", False)
    zq.Measure((data, False), (b"three", False)).of("one two three")


def test_logistic_is_the_least_of_its_loss():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2))
    y = (x @ [2, -1] + rng.normal(size=300) > 0.3).astype(float)
    w = zq._logistic(x, y, 0.1)

    def loss(v):
        z = v[0] + x @ v[1:]
        return np.log1p(np.exp(-z * (2 * y - 1))).sum() + 0.05 * (v ** 2).sum()

    assert all(loss(w) <= loss(w + d) for d in rng.normal(scale=0.01, size=(50, 3)))


def test_held_out_texts_are_judged_right(spark):
    rows, marks = labelled(spark)
    got = zq.judge(frame(spark, rows), marks_frame(spark, marks)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    want = {i: q for i, q, _ in marks}
    out = [r for r in got if r["held_out"]]
    assert 100 < len(out) < 170 and np.mean([r["predicted"] == want[r["doc_id"]] for r in out]) > 0.95


def test_held_out_labels_and_other_columns_do_not_matter(spark):
    rows, marks = labelled(spark, 150)
    held = {r["doc_id"] for r in zq.judge(frame(spark, rows), marks_frame(spark, marks)).where("held_out").collect()}
    turned = [(i, 1 - q if i in held else q, t) for i, q, t in marks]
    other = [(i, t, "fr", f"s{i}", n) for i, t, _, _, n in rows]
    a = zq.judge(frame(spark, rows), marks_frame(spark, marks)).select("doc_id", "score").collect()
    b = zq.judge(frame(spark, other), marks_frame(spark, turned)).select("doc_id", "score").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_odd_rows_and_missing_labels(spark):
    marks = marks_frame(spark, [(1, 1, None), (None, 0, 0), (99, 1, 0), (3, None, 0), (13, 0, 1), (14, 0, None), (8, 1, 0), (4, 1, 0), (12, 0, 0)])
    got = zq.judge(odd_documents(spark), marks).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in got)
    one = zq.judge(odd_documents(spark), marks_frame(spark, [(1, 1, 0), (8, 1, 0), (12, 1, 0)])).collect()
    assert {r["predicted"] for r in one} == {1} and len({r["score"] for r in one}) == 1
    none = zq.judge(odd_documents(spark), marks_frame(spark, [])).collect()
    assert {r["score"] for r in none} == {0.5}
    assert zq.judge(no_documents(spark), marks).collect() == [] and "label" in CLASH


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="benchmark tables not present")
def test_accuracy_on_the_benchmark_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = zq.judge(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 90 and np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95


def test_scores_of_nulls():
    model = zq.Model(None, None, np.array([0.3, 0, 0]), np.zeros(2))
    assert np.allclose(model.score(pa.array([None, "x"]), None), 1 / (1 + np.exp(-0.3)))
