import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import frame, no_documents, odd_documents, odd_rows, rows_of, sentence
from pyspark.sql import functions as F

from pingpath.llm import quality_rules
from pingpath.llm.text_measures import measures


def brute_measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    again = {j for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again)


def test_measures_of_odd_texts():
    texts = [r[1] for r in odd_rows()] + ["a b c a b c", "x\nx\n\nx \nx", "a|b <>&\x0b#\r\n\r\n"]
    m = measures(pa.array(texts))
    got = list(zip(*(m[n].tolist() for n in ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]), strict=True))
    assert got == [brute_measures(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t#é", max_size=40), min_size=1, max_size=6))
def test_measures_of_any_texts(texts):
    m = measures(pa.array(texts))
    got = list(zip(*(m[n].tolist() for n in ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]), strict=True))
    assert got == [brute_measures(t) for t in texts]


def test_odd_rows_keep_every_row(spark):
    rows = rows_of(quality_rules.judge(odd_documents(spark)).select("doc_id", "n_words", "base_failed", "kept"))
    want = []
    for doc_id, text, *_ in odd_rows():
        m = brute_measures(text)
        want.append((doc_id, m[0], m[0] < 50 or 100 * m[4] > 50 * m[0]))
    assert [r[:3] for r in rows] == sorted(want, key=str)
    assert not any(r[2] and r[3] for r in rows)


def test_empty(spark):
    assert quality_rules.judge(no_documents(spark)).count() == 0


def test_buckets_are_narrow(spark):
    values = [0, 1, 127, 128, 129, 255, 256, 1_000_003, 10**15]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", quality_rules.bucket(F.col("v"))).collect()
    assert all(b <= v and (v - b) * 64 <= v for v, b in rows)
    assert [b for v, b in rows[:4]] == [0, 1, 127, 128]


def test_sketches_merge_to_the_sketch_of_all(spark):
    docs = odd_documents(spark).where("text is not null")
    m = quality_rules.measured(docs)
    own = quality_rules.sketches(m)
    assert rows_of(quality_rules.merge(own, [])) == rows_of(
        quality_rules.sketches(m.withColumn("lang", F.lit("x")).withColumn("source", F.lit("y"))).drop("lang", "source"))


def test_thresholds_follow_the_group(spark):
    """A group whose texts all hold many symbols keeps them; the same text in a clean group goes."""
    rng = random.Random(4)
    noisy = lambda: " ".join(w + "###" for w in sentence(rng, 80).split(" "))
    rows = [(i, sentence(rng, 80), "en", "clean", 0) for i in range(300)]
    rows += [(1000 + i, noisy(), "en", "code", 0) for i in range(300)]
    rows += [(5000, noisy(), "en", "clean", 0), (5001, noisy(), "en", "tiny", 0), (5002, sentence(rng, 80), "en", "tiny", 0)]
    kept = dict(quality_rules.judge(frame(spark, rows)).select("doc_id", "kept").collect())
    assert np.mean([kept[i] for i in range(300)]) > 0.99 and all(kept[1000 + i] for i in range(300))
    assert not kept[5000] and kept[5002]


def _repeating(rng, n_words, part):
    """About ``part`` of the words stand in repeated windows, one passage after another."""
    passage = sentence(rng, int(n_words * part / 2))
    return " ".join([passage, sentence(rng, n_words - 2 * len(passage.split(" "))), passage])


def _lines(rng, n, repeated):
    lines = [sentence(rng, 12) for _ in range(n - repeated)]
    return "\n".join(lines + [lines[0]] * repeated)


def test_each_rate_rejects_one_and_keeps_one(spark):
    """45 % repetition goes in a source that has none and stays in one where it is common; short texts are spared."""
    rng = random.Random(6)
    plain = [(i, sentence(rng, 400), "en", "clean", 0) for i in range(250)]
    common = [(1000 + i, _repeating(rng, 1000, 0.3), "en", "lyrics", 0) for i in range(250)]
    lists = [(2000 + i, _lines(rng, 60, 15), "en", "lists", 0) for i in range(250)]
    odd = [(3000, _repeating(rng, 1000, 0.45), "en", "clean", 0), (3001, _repeating(rng, 1000, 0.3), "en", "lyrics", 0),
           (3002, _repeating(rng, 150, 0.45), "en", "clean", 0),
           (3003, _lines(rng, 60, 15), "en", "clean", 0), (3004, _lines(rng, 60, 15), "en", "lists", 0),
           (3005, _lines(rng, 60, 3), "en", "clean", 0),
           (3006, sentence(rng, 400).replace(" ", "! "), "en", "clean", 0),
           (3007, "".join(sentence(rng, 400).split(" ")[i] * 3 + " " for i in range(100)), "en", "clean", 0)]
    rows = quality_rules.judge(frame(spark, plain + common + lists + odd)).collect()
    kept = {r["doc_id"]: r["kept"] for r in rows}
    assert not any(r["base_failed"] for r in rows)
    assert [kept[3000 + i] for i in range(8)] == [False, True, True, False, True, True, False, False]
    for start in (0, 1000, 2000):
        assert np.mean([kept[start + i] for i in range(250)]) > 0.97


def test_a_group_grows_into_its_own_fences(spark):
    """The blend moves with the group's size and no count switches: a verdict changes once, from the wide fence to the own one."""
    rng = random.Random(8)
    noisy = lambda: " ".join(w + "##" for w in sentence(rng, 60).split(" "))
    rows = [(i, sentence(rng, 60), "en", "clean", 0) for i in range(6000)]
    sizes = [1, 5, 30, 199, 200]
    for g, size in enumerate(sizes):
        rows += [(10_000 * (g + 1) + i, noisy(), "en", f"code{size}", 0) for i in range(size)]
    kept = dict(quality_rules.judge(frame(spark, rows)).select("doc_id", "kept").collect())
    share = [np.mean([kept[10_000 * (g + 1) + i] for i in range(size)]) for g, size in enumerate(sizes)]
    assert share[0] == 0 and share[-2:] == [1, 1] and share == sorted(share)


def test_blend_weights(spark):
    own = spark.createDataFrame([("en", "a", "r", 0, 3), ("en", "a", "r", 5, 1), ("en", "b", "r", 5, 4), (None, "a", "r", 9, 8)],
                                "lang string, source string, rate string, bucket long, n long")
    got = {(r.lang, r.source, r.bucket): r.weight for r in quality_rules.blended(own, 8).collect()}
    unit = quality_rules.UNIT  # half of 8 documents for the language, half for everything
    assert got == {("en", "a", 0): 3 * unit + 4 * unit * 3 // 8 + 4 * unit * 3 // 16,
                   ("en", "a", 5): unit + 4 * unit * 5 // 8 + 4 * unit * 5 // 16, ("en", "a", 9): 4 * unit * 8 // 16,
                   ("en", "b", 0): 4 * unit * 3 // 8 + 4 * unit * 3 // 16,
                   ("en", "b", 5): 4 * unit + 4 * unit * 5 // 8 + 4 * unit * 5 // 16, ("en", "b", 9): 4 * unit * 8 // 16,
                   (None, "a", 0): 4 * unit * 3 // 16, (None, "a", 5): 4 * unit * 5 // 16,
                   (None, "a", 9): 8 * unit + 4 * unit + 4 * unit * 8 // 16}
