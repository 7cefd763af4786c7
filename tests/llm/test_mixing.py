import hashlib
import random
from collections import defaultdict
from fractions import Fraction

from llm_cases import frame, no_documents, odd_documents, odd_rows, sentence
from pyspark.sql import functions as F

from pingpath.llm import mixing


def fill(budget, children):
    """Water filling by raising full children one at a time: {name: (weight, capacity)}."""
    got, left, open_ = {}, budget, dict(children)
    while True:
        weight = sum(w for w, _ in open_.values())
        full = [n for n, (w, c) in open_.items() if w > 0 and Fraction(left * w, weight) >= c]
        if not full:
            break
        for n in full:
            got[n] = open_[n][1]
        left -= sum(open_.pop(n)[1] for n in full)
    weight = sum(w for w, _ in open_.values())
    return got | {n: w * left // weight if weight else 0 for n, (w, _) in open_.items()}


def brute(rows, domain, budget_share, epochs, seed, weights):
    leaves = defaultdict(list)
    for doc_id, text, lang, source, *_ in rows:
        leaves[domain(source), lang, source].append((doc_id, len((text or "").encode().split())))
    supply = {k: sum(n for _, n in v) for k, v in leaves.items()}
    total = sum(supply.values())
    budget = {(): min(int(total * budget_share), total * epochs)}
    for level in range(3):
        below = {}
        for parent in {k[:level] for k in supply}:
            children = defaultdict(int)
            for k, s in supply.items():
                if k[:level] == parent:
                    children[k[:level + 1]] += s * epochs
            weigh = weights.get(mixing.LEVELS[level], {})
            below |= fill(budget[parent], {k: (weigh.get(k[-1], 1), c) for k, c in children.items()})
        budget = below
    out = []
    for k, docs in leaves.items():
        whole = budget[k] // max(supply[k], 1)
        part = budget[k] - whole * supply[k]
        out += [(d, e) for e in range(whole) for d, _ in docs]
        upto = 0
        ranked = sorted((hashlib.md5("|".join([str(seed), str(whole)] + ([] if d is None else [str(d)])).encode()).hexdigest(), d is not None, d or 0, d, n)
                        for d, n in docs)
        for *_, d, n in ranked:
            upto += n
            if part > 0 and upto <= part:
                out.append((d, whole))
    return sorted(out, key=str), budget


def domain_map(spark, rows):
    names = {r[3] for r in rows}
    table = spark.createDataFrame([(n,) for n in names], "s string").select("s", mixing.domain_of(F.col("s")))
    return dict(table.collect()).__getitem__


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(500):
        lang = rng.choices(["en", "de", "fr", "es", None], [5, 2, 1, 1, 1])[0]
        source = rng.choices([f"src{k}" for k in range(9)] + [None], [20, *[2] * 8, 1])[0]
        rows.append((i, sentence(rng, rng.randrange(0, 60)), lang, source, 0))
    return rows


def test_against_brute_force(spark):
    rows = corpus(1)
    for share, epochs, weights in [(0.8, 2, mixing.WEIGHTS), (0.5, 1, mixing.WEIGHTS), (3.0, 2, {}), (1.4, 3, {"lang": {"en": 0, "de": 9}})]:
        got = mixing.mix(frame(spark, rows), share, epochs, 17, weights).select("doc_id", "epoch").collect()
        want, budget = brute(rows, domain_map(spark, rows), share, epochs, 17, weights)
        assert sorted((tuple(r) for r in got), key=str) == want
        assert len(want) > 100


def test_shortage_goes_to_siblings_first(spark):
    """Source b of (d, en) has few tokens: a of the same language gets its share, fr gets none of it."""
    t = spark.createDataFrame([("d", "en", "a", 1000), ("d", "en", "b", 10), ("d", "fr", "c", 1000), ("e", "en", "f", 1000)],
                              "domain string, lang string, source string, n_tokens long")
    got = {r["source"]: r["budget"] for r in mixing.leaf_budgets(t, 400 / 3010, 1, {}).collect()}
    assert got == {"a": 90, "b": 10, "c": 100, "f": 200}
    few = t.where("source <> 'a'").withColumn("n_tokens", F.when(F.col("lang") == "fr", 20).otherwise(F.col("n_tokens")))
    got = {r["source"]: r["budget"] for r in mixing.leaf_budgets(few, 400 / 1030, 1, {}).collect()}
    assert got == {"b": 10, "c": 20, "f": 370}


def test_odd_rows(spark):
    got = mixing.mix(odd_documents(spark), 1.0, 2)
    assert got.count() > 0
    everything = mixing.mix(odd_documents(spark), 5.0, 1)
    assert sorted(str(r["doc_id"]) for r in everything.collect()) == sorted(
        str(r[0]) for r in odd_rows() if any((s[1] or "").split() for s in odd_rows() if s[2:4] == r[2:4]))


def test_empty(spark):
    assert mixing.mix(no_documents(spark)).count() == 0


def test_kept_documents_keep_their_columns(spark):
    rows = corpus(2)
    docs = frame(spark, rows)
    kept = mixing.keep_mixed(docs, budget_share=0.8)
    want, _ = brute(rows, domain_map(spark, rows), 0.8, 1, 17, mixing.WEIGHTS)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, _ in want)


def test_a_leaf_without_tokens_is_never_taken(spark):
    """Empty texts come with their leaf's others; a leaf of empty texts alone supplies nothing."""
    rows = [(1, "a b c", "en", "s", 5), (2, "", "en", "s", 0), (3, None, "en", "s", 0), (4, "", "en", "only empty", 0)]
    taken = {r["doc_id"] for r in mixing.mix(frame(spark, rows), budget_share=5.0, epochs=1).collect()}
    assert taken == {1, 2, 3}
