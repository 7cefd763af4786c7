import random
import zlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import frame, no_documents, odd_documents, odd_rows, sentence

from pingpath.llm import sharding
from pingpath.llm.packing import OpenBins, best_fit_decreasing, pack_into


def brute_best_fit(sizes, capacity):
    bins, place = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [(r, b) for b, r in enumerate(bins) if r >= sizes[i]]
        if fits:
            b = min(fits)[1]
        else:
            b = len(bins)
            bins.append(max(capacity, sizes[i]))
        bins[b] -= sizes[i]
        place[i] = b
    return place


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=80), st.integers(1, 70))
def test_tree_packs_like_a_scan(sizes, capacity):
    assert best_fit_decreasing(sizes, capacity) == brute_best_fit(sizes, capacity)


def test_tree_stays_balanced():
    bins = OpenBins()
    for i in range(5000):
        bins.add(i, i)
    assert bins.root.height <= 1.45 * 13
    for i in range(0, 5000, 2):
        assert bins.take_tightest(i) == (i, i)
    assert bins.take_tightest(0) == (1, 1) and bins.root.height <= 1.45 * 12 and bins.take_tightest(10_000) is None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 1000), max_size=120), st.integers(1, 9))
def test_fixed_number_of_bins(sizes, n):
    place = pack_into(sizes, n)
    load = [sum(s for s, p in zip(sizes, place, strict=True) if p == b) for b in range(n)]
    assert all(0 <= p < n for p in place) and sum(load) == sum(sizes)
    assert not sizes or max(load) <= max(max(sizes), -(-sum(sizes) // n) + max(sizes))


def check(out, rows, n=8):
    got = [r.asDict() for r in out.collect()]
    size = lambda t: len((t or "").encode()) + 1
    assert sorted((str(g["doc_id"]), g["size"], g["text_crc32"]) for g in got) == sorted(
        (str(r[0]), size(r[1]), zlib.crc32((r[1] or "").encode())) for r in rows)
    shards, slots = defaultdict(set), defaultdict(list)
    for g in got:
        assert 0 <= g["shard"] < n and g["law"] == "bytes" and g["grown_shard"] is None
        shards[g["text_crc32"], g["size"]].add(g["shard"])
        slots[g["shard"]].append(g["slot"])
    assert all(len(s) == 1 for s in shards.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    load = [sum(g["size"] for g in got if g["shard"] == s) for s in range(n)]
    return load


def test_odd_rows(spark):
    check(sharding.shard(odd_documents(spark)), odd_rows())


def test_empty(spark):
    assert sharding.shard(no_documents(spark)).count() == 0


def test_levels_and_a_hot_group(spark):
    rng = random.Random(9)
    rows = [(i, sentence(rng, rng.randrange(5, 60)), "en", "a", 0) for i in range(1500)]
    hot = sentence(rng, 20)
    rows += [(5000 + i, hot, "en", "a", 0) for i in range(40)] + [(9000 + i, None, "en", "a", 0) for i in range(5)]
    load = check(sharding.shard(frame(spark, rows), task_items=300, bins_per_shard=8), rows)
    assert max(load) < 1.03 * min(load)
    one = check(sharding.shard(frame(spark, rows)), rows)
    assert max(one) - min(one) <= 60


def test_a_group_larger_than_a_shard(spark):
    rng = random.Random(10)
    rows = [(i, "the same long text " * 20, "en", "a", 0) for i in range(300)]
    rows += [(1000 + i, sentence(rng, 20), "en", "a", 0) for i in range(300)]
    load = sorted(check(sharding.shard(frame(spark, rows)), rows))
    assert load[-1] == 300 * (len("the same long text " * 20) + 1) and load[6] < 1.1 * load[0]


def test_fewest_shards_of_a_capacity(spark):
    rng = random.Random(11)
    rows = [(i, "x" * rng.randrange(50, 400), "en", "a", 0) for i in range(200)]
    sized = {r[1]: 0 for r in rows}
    for r in rows:
        sized[r[1]] += len(r[1]) + 1
    out = sharding.shard(frame(spark, rows), n_shards=None, capacity=5_000)
    loads = defaultdict(int)
    for r in out.collect():
        loads[r["shard"]] += r["size"]
    assert all(v <= max(5_000, max(sized.values())) for v in loads.values())
    assert len(loads) == len(set(brute_best_fit(sorted(sized.values()), 5_000)))
