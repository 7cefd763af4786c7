import hashlib
import random
from collections import defaultdict

from llm_cases import frame, no_documents, odd_documents, odd_rows, rows_of
from pyspark.sql import functions as F

from pingpath.llm import line_dedup

BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    holders = defaultdict(set)
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            for line in (text or "").split("\n"):
                holders[line.strip(BLANKS).translate(LOWER)].add(doc_id)
    out = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        keep = []
        for line in lines:
            k = line.strip(BLANKS).translate(LOWER)
            if doc_id is None or len(k) < 10 or min(holders[k]) == doc_id:
                keep.append(line)
        out.append((doc_id, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=str)


def run(docs, **how):
    cut = line_dedup.apply_bitmaps(docs.select("doc_id", "text"), line_dedup.keep_bitmaps(docs, **how))
    return rows_of(cut.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256)))


def test_odd_rows(spark):
    assert run(odd_documents(spark)) == brute(odd_rows())


def test_random_lines_in_few_bands(spark):
    rng = random.Random(1)
    pool = [f"Line number {i} of the pool" for i in range(40)] + ["short", "", "  ", "one hot line for all"]
    rows = [(i, "\n".join(rng.choice(pool) + rng.choice(["", " ", "\t"]) for _ in range(rng.randrange(1, 150))) +
             "\none hot line for all", "en", "a", 0) for i in range(200)]
    for bands in (1, 3, 64):
        assert run(frame(spark, rows), bands=bands) == brute(rows)


def test_bitmaps_hold_only_words_with_dropped_lines(spark):
    shared = "the line that both documents hold"
    rows = [(1, shared, "en", "a", 0), (2, "\n".join(f"own line {i:04d} of two" for i in range(200)) + "\n" + shared, "en", "a", 0)]
    kept = line_dedup.keep_bitmaps(frame(spark, rows)).collect()
    assert [(r["doc_id"], [(w["word"], w["bits"]) for w in r["keep"]]) for r in kept] == [(2, [(200 // 64, ~(1 << (200 % 64)))])]


def test_empty(spark):
    assert run(no_documents(spark)) == []


def test_no_python_on_the_main_path(spark):
    docs = odd_documents(spark)
    plan = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "InArrow" not in plan


def test_time_is_linear_in_the_lines_of_a_text(spark):
    """Two equal texts of many lines: twice the lines, well under three times the time."""
    import time

    def took(n):
        text = "\n".join(f"line number {i} of a very long text" for i in range(n))
        docs = frame(spark, [(1, text, "en", "a", 0), (2, text, "en", "a", 0)], extras=False)
        start = time.time()
        got = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs)).select("doc_id", "n_lines", "n_dropped", "text").collect()
        assert sorted((r["doc_id"], r["n_lines"], r["n_dropped"], len(r["text"])) for r in got) == [(1, n, 0, len(text)), (2, n, n, 0)]
        return time.time() - start

    took(1_000)
    short, long = took(64_000), took(200_000)
    assert long < 20 and long < 3 * 200 / 64 * max(short, 1)
