import random
import re

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import frame, no_documents, odd_documents, odd_rows, rows_of, sentence

from pingpath.llm import ngram_join
from pingpath.llm.jaccard_regions import Members, components, linked_pairs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, num=90, den=100, n=3):
    sets = [shingles(r[1], n) for r in rows]
    reach = list(range(len(rows)))

    def find(i):
        while reach[i] != i:
            reach[i] = reach[reach[i]]
            i = reach[i]
        return i

    usable = [i for i, r in enumerate(rows) if r[0] is not None and sets[i]]
    first = {}
    for i in usable:
        reach[find(i)] = find(first.setdefault(sets[i], i))
    by_id = {}
    for i in usable:
        reach[find(i)] = find(by_id.setdefault(rows[i][0], i))
    links = dict.fromkeys(first, 0)
    distinct = sorted(first, key=len)
    for a, s in enumerate(distinct):
        for t in distinct[a + 1:]:
            if num * len(t) > den * len(s):
                break
            k = len(s & t)
            if den * k >= num * (len(s) + len(t) - k):
                reach[find(first[s])] = find(first[t])
                links[s] += 1
                links[t] += 1
    least = {}
    for i in usable:
        least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return sorted(((r[0], len(sets[i]), least[find(i)] if i in set(usable) else r[0], links.get(sets[i], 0) if i in set(usable) else 0)
                   for i, r in enumerate(rows)), key=str)


def run(docs, **how):
    return rows_of(ngram_join.join(docs, **how).select("doc_id", "n_shingles", "component_id", "n_links"))


def edited(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


def near_copies(seed, clusters, members, words=90, edits=4):
    rng = random.Random(seed)
    rows = []
    for _ in range(clusters):
        base = sentence(rng, words + rng.randrange(-20, 20), 10**5)
        for _ in range(members):
            rows.append((len(rows), edited(rng, base, rng.randrange(edits)), "en", "a", 0))
    rows += [(len(rows) + i, sentence(rng, rng.randrange(1, 200), 50), "en", "a", 0) for i in range(60)]
    rng.shuffle(rows)
    return rows


def test_odd_rows(spark):
    assert run(odd_documents(spark)) == brute(odd_rows())


def test_empty(spark):
    assert run(no_documents(spark)) == []


def test_many_small_clusters(spark):
    rows = near_copies(1, 40, 5, edits=3)
    want = brute(rows)
    assert sum(r[3] for r in want) > 50
    assert run(frame(spark, rows)) == want


def test_rows_of_one_id_connect_their_texts(spark):
    rng = random.Random(2)
    a, b = sentence(rng, 50), sentence(rng, 50)
    rows = [(5, a, "en", "a", 0), (7, a, "en", "a", 0), (7, b, "en", "a", 0), (9, b, "en", "a", 0)]
    assert run(frame(spark, rows)) == brute(rows)
    assert {r[2] for r in run(frame(spark, rows))} == {5}


@pytest.mark.parametrize("region_items", [3_000, 20_000])
def test_regions_split_by_pivots_and_blocks(spark, region_items):
    """One large group of near copies, cut far below its size."""
    rows = near_copies(3, 1, 160, words=110, edits=14) + [(10_000 + r[0], r[1], "en", "a", 0) for r in near_copies(4, 3, 30)]
    want = brute(rows)
    assert run(frame(spark, rows), region_items=region_items) == want


def test_the_boundary_of_the_threshold(spark):
    """Nine of ten shingles in common link (90 of 100), eight of nine do not."""
    words = [f"w{i}" for i in range(12)]
    rows = [(1, " ".join(words), "en", "a", 0), (2, " ".join(words[:11]), "en", "a", 0), (3, " ".join(words[:10]), "en", "a", 0)]
    assert run(frame(spark, rows)) == [(1, 10, 1, 1), (2, 9, 1, 1), (3, 8, 3, 0)]


def test_region_join_by_cells_matches_all_pairs():
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 10**6, 80)
        for _ in range(8):
            keep = rng.random(80) > 0.06
            sets.append(np.unique(np.concatenate([base[keep], rng.integers(0, 10**6, rng.integers(0, 5))])))
    found = {(int(a), int(b)) for x, y in linked_pairs(Members(sets), 90, 100) for a, b in zip(x, y, strict=True)}
    every = [(int(a), int(b)) for x, y in linked_pairs(Members(sets), 90, 100) for a, b in zip(x, y, strict=True)]
    want = set()
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            k = len(np.intersect1d(sets[i], sets[j]))
            if 100 * k >= 90 * (len(sets[i]) + len(sets[j]) - k):
                want.add((i, j))
    assert found == want and len(every) == len(found) and len(want) > 50


def test_components():
    assert components(6, np.array([4, 1, 2]), np.array([5, 2, 4])).tolist() == [0, 1, 1, 3, 1, 1]


def test_every_link_shares_a_signature():
    """The pigeonhole of the first pivots, over all sizes near each link."""
    rng = random.Random(6)
    pairs = []
    for size in [*range(9, 60), 100, 300]:
        words = [f"a{size}x{i}" for i in range(size + 2)]
        cut = max(0, size // 10 - 1)
        pairs.append((" ".join(words), " ".join(words[cut:])))
        swapped = list(words)
        swapped[rng.randrange(len(words))] = "other"
        pairs.append((" ".join(words), " ".join(swapped)))
    for a, b in pairs:
        x, y = shingles(a), shingles(b)
        if 100 * len(x & y) >= 90 * len(x | y):
            value, cuts = ngram_join.shingle_sets(pa.array([a, b]), 3)
            sig, text = ngram_join.signatures(value, cuts, 90, 100)
            assert set(sig[text == 0].tolist()) & set(sig[text == 1].tolist())


def test_one_document_of_each_component_stays(spark):
    rows = near_copies(8, 10, 6) + [(9_000, "same text of a repeated row", "en", "a", 0)] * 2 + [(None, None, "en", "a", 0)]
    left = ngram_join.keep_one(frame(spark, rows))
    want = brute(rows)
    assert left.columns == frame(spark, rows).columns
    assert sorted((r["doc_id"] for r in left.collect()), key=str) == sorted({r[2] for r in want}, key=str)


@pytest.mark.parametrize("region_items", [3_000, 20_000])
def test_components_without_counts(spark, region_items):
    """One dense group and groups at the edge of the threshold, cut far below their size."""
    rows = near_copies(13, 1, 200, words=110, edits=5) + [(10_000 + r[0], r[1], "en", "a", 0) for r in near_copies(14, 3, 40, edits=9)]
    got = run(frame(spark, rows), region_items=region_items, count=False, n=5, num=80)
    assert got == sorted(((*r[:3], None) for r in brute(rows, 80, 100, 5)), key=str)


def test_what_links_to_a_pivot_is_not_compared_again(spark, monkeypatch):
    """Ten times the members of a dense group: about ten times the rows that meet in regions."""
    met = []
    join_regions = ngram_join._join_regions

    def counted(regions, sets, num, den):
        met.append(regions.count())
        return join_regions(regions, sets, num, den)

    monkeypatch.setattr(ngram_join, "_join_regions", counted)
    for members in (200, 2_000):
        rng = random.Random(15)
        base = sentence(rng, 200, 10**5)
        rows = [(i, edited(rng, base, 1 + i % 3), "en", "a", 0) for i in range(members)]
        out = ngram_join.join(frame(spark, rows), n=5, num=80, region_items=10_000, count=False)
        assert {r["component_id"] for r in out.select("component_id").distinct().collect()} == {0}
    assert met[1] < 20 * max(met[0], 200)
