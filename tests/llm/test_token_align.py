"""Alignment against a byte-by-byte brute force with both libraries."""

import hashlib
import random
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_cases import frame, no_documents, odd_rows, sentence

from pingpath.llm import token_align
from pingpath.llm.queries import vocabulary_path

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
A, B = vocabulary_path(), vocabulary_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def sides():
    with open(A, encoding="utf-8") as f, open(B, "rb") as g:
        return token_align.Sides(f.read(), g.read())


def brute(rows, sides):
    encoded, total = [], Counter()
    for r in rows:
        text, groups, links = r[1], [], []
        (a,), (b,) = sides.encode([text or ""])
        a_owner = [i for i, t in enumerate(a) for _ in sides.a_bytes[t]]
        b_owner = [i for i, t in enumerate(b) for _ in sides.b_bytes[t]]
        assert len(a_owner) == len(b_owner)
        links = sorted(set(zip(a_owner, b_owner, strict=True)))
        i = j = 0
        for at in range(len(a_owner)):
            if at + 1 == len(a_owner) or (a_owner[at] != a_owner[at + 1] and b_owner[at] != b_owner[at + 1]):
                groups.append((a[i:a_owner[at] + 1], b[j:b_owner[at] + 1]))
                i, j = a_owner[at] + 1, b_owner[at] + 1
        pairs = [(a[x], b[y]) for x, y in links]
        total.update(pairs)
        shown = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        encoded.append((r[0], len(a), len(b), len(groups), pairs, hashlib.sha256(shown.encode()).hexdigest() if groups else ""))
    best = defaultdict(int)
    for (_, y), n in total.items():
        best[y] = max(best[y], n)
    return sorted(((i, na, nb, ng, len(p), sum(total[x] == best[x[1]] for x in p), sum(total[x] for x in p), h)
                   for i, na, nb, ng, p, h in encoded), key=str)


def result(docs, **k):
    rows = token_align.alignment(docs, A, B, **k)
    assert rows.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in rows.collect()), key=str)


def texts():
    rng = random.Random(5)
    return ["<|endoftext|> and <s> </s> <unk> <0x41>", "a▁b", "tabs\tand  double  spaces ", "\U0001f600 émigré naïve Zürich 北京市  x",
            "line\n\n\nends\r\n", "́combining", "ﬁ ligature", "x\x00y", " lead", *(sentence(rng, 50) for _ in range(20)),
            *("".join(rng.choice("aeiou thslñß漢\n.") for _ in range(200)) for _ in range(20))]


@pytest.mark.parametrize("block", [1, 5_000, 1 << 21])
def test_against_brute_force(spark, sides, block):
    rows = [r for r in odd_rows() if not r[1] or len(r[1]) < 50_000]
    rows += [(100 + i, t, "en", "a", len(t)) for i, t in enumerate(texts())]
    want = brute(rows, sides)
    assert sum(w[1] == 0 for w in want) < len(want) / 3 and max(w[4] for w in want) > 100
    assert result(frame(spark, rows), block_bytes=block) == want


def test_encoding_is_the_libraries(sides):
    assert sides.a_ranks
    t = [*texts(), "x" + " " * 300_000 + "y\n" * 2_000, "a" * 200_000, "\n \t" * 50_000, "é." * 50_000]
    plain = tokenizers.Tokenizer.from_file(A)
    plain.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)
    for text, a, b in zip(t, *sides.encode(t), strict=True):
        if a:
            assert a == plain.encode(" " + text, add_special_tokens=False).ids and b == pieces.encode(text)
            assert b"".join(sides.a_bytes[i] for i in a) == (" " + text).encode()
        else:
            assert b == [] and ("▁" in text or "\x00" in text)


def test_long_texts_and_copies_count_whole(spark, sides):
    rows = [r for r in odd_rows() if r[1] and len(r[1]) >= 50_000]
    got = result(frame(spark, rows))
    assert [(g[0], g[1], g[2]) for g in got] == sorted(
        ((r[0], *(len(x[0]) for x in sides.encode([r[1]]))) for r in rows), key=str)


@pytest.mark.parametrize("seed", range(5))
def test_gallop_from_any_start(seed):
    rng = np.random.default_rng(seed)
    ends = np.cumsum(rng.integers(1, 6, 500))
    targets = rng.integers(1, ends[-1] + 1, 300)
    start = rng.integers(-50, 600, 300)
    assert token_align.gallop(targets, ends, start).tolist() == [bisect_left(ends.tolist(), t) for t in targets.tolist()]


def test_empty(spark):
    assert result(no_documents(spark)) == []
