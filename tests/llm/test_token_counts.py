import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import no_documents, odd_documents, odd_rows, rows_of

from pingpath.llm import token_counts
from pingpath.llm.queries import vocabulary_path
from pingpath.llm.token_counts import Counter, MergeTable, count_piece

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(vocabulary_path())


@pytest.fixture(scope="module")
def counter():
    return Counter(MergeTable.from_json(vocabulary_path()), 1000)


def test_odd_rows(spark, library):
    want = []
    for doc_id, text, *_ in odd_rows():
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want.append((doc_id, len((text or "").encode()), n, n > 1024))
    assert rows_of(token_counts.count_tokens(odd_documents(spark), vocabulary_path())) == sorted(want, key=str)


def test_empty(spark):
    assert token_counts.count_tokens(no_documents(spark), vocabulary_path()).count() == 0


@pytest.mark.parametrize("text", ["<|endoftext|>", "a <|endoftext|><|endoftext|> b", "  \n\n  x", "it's IT'S 've", "x\r\n y\t\tz  ",
                                  "​ x\x1c\x85y", "日本語 123 ٣٤", "<|endoftext", "\U0001f916\U0001f916 ok", "a" * 5000])
def test_like_the_library(text, library, counter):
    assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text_like_the_library(library, counter, text):
    assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_heap_merges_like_repeated_scans():
    rng = random.Random(2)
    for _ in range(300):
        merges = []
        symbols = [bytes([b]) for b in b"abcd"]
        for _ in range(12):
            pair = (rng.choice(symbols), rng.choice(symbols))
            if pair not in merges:
                merges.append(pair)
                symbols.append(pair[0] + pair[1])
        table = MergeTable(merges, [])
        word = bytes(rng.choice(b"abcd") for _ in range(rng.randrange(1, 14)))
        parts = [bytes([b]) for b in word]
        while True:
            known = [(merges.index((a, b)), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (a, b) in merges]
            if not known:
                break
            i = min(known)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        assert count_piece(word, table.pairs) == len(parts)
