"""Merkle manifest against a plain recursive build, on hard rows and random forests."""

import hashlib
import random
import zlib

import pytest
from llm_cases import frame, no_documents, odd_rows, sentence
from pyspark.sql import functions as F

from pingpath.llm import merkle


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    fields = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)]
    return digest(*fields)


def grow(nodes):
    """Levels of one tree, and each first node's siblings (left, right) from the bottom up."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest(*below[i:i + 3]) for i in range(0, len(below), 3)])
    paths = []
    for at in range(len(nodes)):
        steps, i = [], at
        for level in levels[:-1]:
            run = i // 3 * 3
            steps.append(("".join(level[run:i]), "".join(level[i + 1:run + 3])))
            i //= 3
        paths.append(steps)
    return levels[-1][0], paths


def brute(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[3], []).append((r, leaf_of(*r)))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in names:
        trees[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        built[s] = grow([h for _, h in trees[s]])
    root, tops = grow([built[s][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for (r, h), path in zip(trees[s], built[s][1], strict=True):
            steps = path + tops[k]
            node = h
            if r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                node = leaf_of(r[0], r[1].replace("\n", ""), *r[2:])
            for a, b in steps:
                node = digest(a, node, b)
            out.append((r[0], h, built[s][0], root, digest(*(a + b for a, b in steps)), node, node == root))
    return sorted(out, key=str)


def result(docs, every=3):
    rows = merkle.verify(docs, merkle.altered(F.col("doc_id"), F.col("text")), every)
    assert rows.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in rows.collect()), key=str)


def made(sizes, seed):
    rng = random.Random(seed)
    rows, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            i += rng.randrange(1, 4)
            text = "\n".join(sentence(rng, 4) for _ in range(rng.randrange(1, 4)))
            rows.append((i, text, rng.choice(["en", "de", None]), source, len(text)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("every", [1, 3])
def test_odd_rows(spark, every):
    rows = odd_rows()
    assert result(frame(spark, rows), every) == brute(rows)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 1, "b": 28, None: 3}, {f"s{i}": 1 + i % 3 for i in range(30)}, {"hot": 800, "é": 81, "z": 27, "": 2}])
def test_forests(spark, sizes):
    rows = made(sizes, len(sizes))
    assert result(frame(spark, rows, extras=False)) == brute(rows)


def test_a_source_is_cut_into_many_ranges(spark):
    rows = [(i // 2, f"t{i % 5}\nx", "en", "one", 4) for i in range(3000)]  # repeated ids, equal rows
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert result(frame(spark, rows, extras=False)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_only_every_third_level_is_stored_and_untouched_copies_verify(spark):
    rows = made({"a": 100, "b": 5}, 1)
    manifest = merkle.build(frame(spark, rows, extras=False))
    assert [lv.count() for lv in manifest.sources.levels] == [105, 5, 2]
    assert [lv.count() for lv in manifest.dataset.levels] == [2, 1]
    assert manifest.root == brute(rows)[0][3]
    rows = merkle.verify(frame(spark, rows, extras=False))
    assert rows.where("NOT verified").isEmpty()


def test_empty(spark):
    assert result(no_documents(spark)) == [] and merkle.build(no_documents(spark)).root is None
