"""The pipeline stage by stage against brute force, and on hard and empty tables."""

import random

import pytest
from llm_cases import frame, odd_documents, odd_rows, sentence
from test_decontamination import brute as brute_hits
from test_mixing import brute as brute_mix
from test_mixing import domain_map
from test_ngram_join import brute as brute_join
from test_ngram_join import edited
from test_sharding import check as check_shards

import corpus_pipeline
from pingpath.llm import mixing

RUDE = ["idiot", "scum", "moron", "loser"]
BENCH = "item_id long, text string"
LABELS = "doc_id long, quality int, toxic int"


def corpus():
    rng = random.Random(12)
    items = [(i, sentence(rng, 25, 10**5)) for i in range(6)]
    rows, labels, toxic = [], [], set()
    for i in range(700):
        text = sentence(rng, rng.randrange(20, 80), 10**4)
        if i % 5 == 0:
            w = text.split(" ")
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(RUDE)
            text, _ = " ".join(w), toxic.add(i)
        elif i % 17 == 0:
            text += " " + " ".join(rng.choice(items)[1].split(" ")[3:18])
        elif i % 7 == 0 and rows:
            text = edited(rng, rows[rng.randrange(len(rows))][1], rng.choice([0, 1]))
        rows.append((i, text, rng.choice(["en", "de"]), f"s{rng.randrange(5)}", len(text)))
    for i, text, *_ in rows:
        labels.append((i, 1, int(any(w in RUDE for w in text.split(" ")))))
    return rows, labels, items


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    rows, labels, items = corpus()
    folder = str(tmp_path_factory.mktemp("corpus"))
    frame(spark, rows, extras=False).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, BENCH).write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, labels, items


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stage_by_stage_against_brute_force(spark, case):
    folder, rows, labels, items = case
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    one = stages["toxicity"](spark, docs, folder)
    bad = {i for i, _, t in labels if t}
    left = [r for r in rows if r[0] not in bad]
    assert one.columns == docs.columns and plain(one) == sorted(left, key=str) and len(bad) > 100

    two = stages["n-gram Jaccard join"](spark, one, folder)
    keep = {c for _, _, c, _ in brute_join(left, 80, 100, 5)}
    after = [r for r in left if r[0] in keep]
    assert two.columns == docs.columns and plain(two) == sorted(after, key=str) and len(after) < len(left)

    three = stages["benchmark decontamination"](spark, two, folder)
    clean = {r[0] for r in brute_hits(after, items) if not r[5]}
    rest = [r for r in after if r[0] in clean]
    assert three.columns == docs.columns and plain(three) == sorted(rest, key=str) and len(rest) < len(after)

    four = stages["mixing sources to target weights"](spark, three, folder)
    taken = {d for d, _ in brute_mix(rest, domain_map(spark, rest), 0.8, 1, 17, mixing.WEIGHTS)[0]}
    mixed = [r for r in rest if r[0] in taken]
    assert four.columns == docs.columns and plain(four) == sorted(mixed, key=str) and len(mixed) < len(rest)

    load = check_shards(stages["sharding"](spark, four, folder), mixed)
    assert max(load) - min(load) <= max(len(r[1]) for r in mixed) + 1
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()} == taken


def test_hard_and_empty_tables(spark, case, tmp_path):
    folder = case[0]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd_documents(spark), folder)
        assert out.columns == odd_documents(spark).columns and out.count() <= len(odd_rows()), name
        assert stage(spark, odd_documents(spark).limit(0), folder).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, odd_documents(spark), folder).count() == len(odd_rows())
    empty = str(tmp_path / "empty")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{empty}/labels.parquet")
    spark.createDataFrame([], BENCH).write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
