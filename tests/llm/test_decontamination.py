import hashlib
import random
import re

from llm_cases import frame, no_documents, odd_documents, odd_rows, rows_of, sentence

from pingpath.llm import decontamination
from pingpath.llm.decontamination import WuManber

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = "item_id long, text string, size string, spans string"


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(rows, items, window=10):
    out = []
    for doc_id, text, *_ in rows:
        w = split(text)
        hit, ids = set(), set()
        for item_id, item, *_ in items:
            v = split(item)
            for i in range(max(1, len(v) - window + 1) if v else 0):
                p = v[i:i + window]
                for j in range(len(w) - len(p) + 1):
                    if w[j:j + len(p)] == p:
                        hit |= set(range(j, j + len(p)))
                        ids.add(item_id)
        ids = sorted(str(i) for i in ids if i is not None)
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def case():
    rng = random.Random(5)
    rows = [r for r in odd_rows() if r[1] is None or len(r[1]) < 5_000]
    base = rows[0][1].split(" ")
    items = [(1, " ".join(base[5:30]).upper() + "!", "x", "x"), (2, "one", "x", "x"), (3, None, "x", "x"), (4, "", "x", "x"),
             (5, "own words here", "x", "x"), (6, sentence(rng, 12), "x", "x"), (1, " ".join(base[5:30]), "x", "x"),
             (10, " ".join(base[100:110]), "x", "x"), (None, "tied line of text tied line of text tied line of text", "x", "x"),
             (7, "two", "x", "x"), (8, "?!", "x", "x")]
    return rows, items


def test_odd_rows_against_brute_force(spark):
    rows, items = case()
    bench = spark.createDataFrame(items, ITEMS)
    want = brute(rows, items)
    assert rows_of(decontamination.find_contamination(frame(spark, rows), bench)) == want
    assert sum(r[5] for r in want) >= 5
    left = decontamination.drop_contaminated(frame(spark, rows), bench)
    assert left.columns == frame(spark, rows).columns
    assert sorted((r["doc_id"] for r in left.collect()), key=str) == sorted((r[0] for r in want if not r[5]), key=str)


def test_blocks_of_the_benchmark_give_the_same(spark):
    rows, items = case()
    bench = spark.createDataFrame(items, ITEMS)
    assert rows_of(decontamination.find_contamination(frame(spark, rows), bench, block_words=8)) == brute(rows, items)
    left = decontamination.drop_contaminated(frame(spark, rows), bench, block_words=8)
    assert left.count() == sum(not r[5] for r in brute(rows, items))


def test_empty_sides(spark):
    none = spark.createDataFrame([], ITEMS)
    assert decontamination.find_contamination(no_documents(spark), none).count() == 0
    found = decontamination.find_contamination(odd_documents(spark), none).collect()
    assert len(found) == len(odd_rows()) and not any(r["contaminated"] for r in found)


def test_wu_manber_finds_all_and_skips():
    rng = random.Random(7)
    patterns = {tuple(rng.choice([b"a", b"b", b"c"]) for _ in range(4)) for _ in range(12)}
    text = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(3000)]
    found = sorted(WuManber(patterns, 4).find(text))
    assert found == sorted((i, tuple(text[i:i + 4])) for i in range(len(text) - 3) if tuple(text[i:i + 4]) in patterns)
    machine = WuManber([tuple(b"p%d" % i for i in range(10))], 10)
    assert machine.shift == {(b"p%d" % i, b"p%d" % (i + 1)): 8 - i for i in range(9)}


def test_shared_tables_and_sparse_slots(monkeypatch):
    """A table of four slots, where nearly every block collides, changes no result."""
    monkeypatch.setattr(decontamination, "_SLOTS", (2, 2))
    rng = random.Random(17)
    word = lambda: rng.choice([b"a", b"b", b"c", b"dd"])
    for m in (1, 2, 3, 7):
        patterns = {tuple(word() for _ in range(m)) for _ in range(9)}
        text = [word() for _ in range(800)]
        assert sorted(WuManber(patterns, m).find(text)) == [
            (i, tuple(text[i:i + m])) for i in range(len(text) - m + 1) if tuple(text[i:i + m]) in patterns]


def test_a_worker_compiles_a_block_once(monkeypatch):
    built = []
    monkeypatch.setattr(decontamination, "_BUILT", {})
    for name in ("a", "a", "b", "b"):
        decontamination._machine(name, lambda: built.append(1) or [(1, b"some words")], 10)
    assert len(built) == 2 and list(decontamination._BUILT) == ["b"]


def test_a_full_block_stays_small():
    """A million benchmark words take under 100 MB and are all found again."""
    import tracemalloc
    rng = random.Random(3)
    items = [(i, " ".join(f"w{rng.randrange(50_000)}" for _ in range(500)).encode()) for i in range(2_000)]
    tracemalloc.start()
    machine = decontamination.Benchmark(items, 10)
    size, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert size < 100e6
    spans, found = machine.search(b"x y z".split() + decontamination.split_words(items[77][1])[100:130] + [b"x"] * 50)
    assert spans == [(3, 33)] and found == {77}
