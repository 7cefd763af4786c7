"""Quality rules: thresholds learnt per language and source from mergeable quantile sketches.

1. One vectorised pass measures every text (``text_measures``); the measures,
   without texts, are staged.
2. Each measure becomes a rate in parts per 10,000 (or hundredths of a character
   for the mean word length).  A sketch counts rates in log-linear buckets: exact
   below 128, seven leading bits above, so a bucket is at most 1/64 of its value
   wide.  Sketches are plain counts: they merge by addition, exactly and in any
   order, and a group has some 400 buckets a measure however many rows it has.
   Only documents that pass the base rules enter.
3. Every (language, source) blends its own sketch with those of its language and of
   everything, which weigh as much as ``prior`` documents together, half each: a
   small group mostly follows the wider ones, a large one follows itself, and no
   group size switches between them.  Weights are whole millionths of a document.
4. A fence is the blend's upper quartile plus the widest of ``reach`` interquartile
   ranges, twice the way from there to the 90th percentile (what a rate has that is
   zero for most documents) and the rate's ``slack`` (what it has where even that is
   zero); the mean word length also has a lower one.  The two rates of repetition
   leave out what a text of any length may repeat (``SPARED``), so that one passage
   told twice in a short text is no repetition.  The fences are joined to the
   measures; a document beyond a fence is not kept.

The join is on (language, source): the plan broadcasts the fences while they are
small and otherwise splits the skewed source, both by measured size.

Defined cases: a null or empty text has no words and fails the base rules; null
languages and sources are groups of their own; repeated rows each count and each
give a row; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pingpath.llm.common import SLICE_BYTES, staged
from pingpath.llm.text_measures import NAMES, measures
from pingpath.llm.wordtable import slices

#: Words in repeated windows, and repeated lines, that any text may hold (a passage of 50 words told twice; four lines).
SPARED = {"n_repeat_words": 100, "n_dup_lines": 4}

#: rate: (numerator, denominator, factor, slack, has a lower fence)
RATES = {
    "symbols": ("n_symbols", "word_chars", 10_000, 200, False),
    "marks": ("n_marks", "word_chars", 10_000, 200, False),
    "word_length": ("word_chars", "n_words", 100, 100, True),
    "dup_lines": (f"greatest(n_dup_lines - {SPARED['n_dup_lines']}, 0)", "n_lines", 10_000, 1_000, False),
    "repeats": (f"greatest(n_repeat_words - {SPARED['n_repeat_words']}, 0)", "n_words", 10_000, 1_000, False),
}

#: Weight of one document in a blend.
UNIT = 1_000_000


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the measures of each text, staged."""
    cols = ["doc_id", "lang", "source"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                m = measures(part.column("text"))
                yield pa.RecordBatch.from_pydict({c: part.column(c) for c in cols}
                                                 | {n: pa.array(m[n], pa.int64()) for n in NAMES})

    kept = docs.select(*cols, "text")
    schema = ", ".join([f"{c} {kept.schema[c].dataType.simpleString()}" for c in cols] + [f"{n} long" for n in NAMES])
    return staged(kept.mapInArrow(run, schema).withColumn(
        "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))), "measures")


def _rate(name: str) -> Column:
    top, below, factor, _, _ = RATES[name]
    return F.expr(f"({factor} * {top}) div greatest({below}, 1)")


def bucket(v: Column) -> Column:
    """Lower end of the log-linear bucket of a whole number."""
    shift = F.greatest(F.length(F.bin(v)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def sketches(m: DataFrame) -> DataFrame:
    """(lang, source, rate, bucket, n) over the documents that pass the base rules."""
    rates = F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), bucket(_rate(r)).alias("bucket")) for r in RATES]))
    return (m.where(~F.col("base_failed")).select("lang", "source", rates.alias("r"))
            .groupBy("lang", "source", "r.rate", "r.bucket").agg(F.count("*").alias("n")))


def merge(sketch: DataFrame, keys: list[str]) -> DataFrame:
    return sketch.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))


def blended(own: DataFrame, prior: int) -> DataFrame:
    """(lang, source, rate, bucket, weight): each group's sketch plus ``prior`` documents' worth of the wider ones."""
    half = prior * UNIT // 2
    groups = own.select("lang", "source", "rate").distinct()

    def shares(keys: list[str]) -> DataFrame:
        total = F.sum("n").over(Window.partitionBy(*keys, "rate"))
        return (merge(own, keys).withColumn("total", total)
                .select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("rate").alias("_rate"), "bucket",
                        F.expr(f"({half} * n) div total").alias("weight")))

    of_lang, of_all = shares(["lang"]), F.broadcast(shares([]))  # at most some thousand buckets a rate, whatever the rows
    cols = ["lang", "source", "rate", "bucket", "weight"]
    parts = [own.withColumn("weight", F.col("n") * UNIT),
             groups.join(of_lang, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("rate") == F.col("_rate"))),
             groups.join(of_all, F.col("rate") == F.col("_rate"))]
    return (reduce(DataFrame.unionByName, [p.select(*cols) for p in parts])
            .groupBy("lang", "source", "rate", "bucket").agg(F.sum("weight").alias("weight")))


def fences(blend: DataFrame, reach: int) -> DataFrame:
    """One row per (lang, source), as ``_lang`` and ``_source``: the fences of every rate."""
    group = Window.partitionBy("lang", "source", "rate")
    at = lambda part, of: F.min(F.when(of * F.col("upto") >= part * F.col("total"), F.col("bucket")))
    q = (blend.withColumn("total", F.sum("weight").over(group))
         .withColumn("upto", F.sum("weight").over(group.orderBy("bucket")))
         .groupBy("lang", "source", "rate").agg(at(1, 4).alias("q1"), at(3, 4).alias("q3"), at(9, 10).alias("q90")))
    out = []
    for r, (_, _, _, slack, low) in RATES.items():
        spread = reach * (F.col("q3") - F.col("q1"))
        high = F.col("q3") + F.greatest(spread, 2 * (F.col("q90") - F.col("q3")), F.lit(slack))
        out.append(F.max(F.when(F.col("rate") == r, high)).alias(f"{r}_high"))
        if low:
            out.append(F.max(F.when(F.col("rate") == r, F.col("q1") - F.greatest(spread, F.lit(slack)))).alias(f"{r}_low"))
    return q.groupBy(F.col("lang").alias("_lang"), F.col("source").alias("_source")).agg(*out)


def judge(docs: DataFrame, reach: int = 8, prior: int = 50) -> DataFrame:
    """doc_id, the measures, base_failed and kept, one row per document row."""
    m = measured(docs)
    own = staged(sketches(m), "sketches")
    limits = fences(blended(own, prior), reach)
    joined = m.join(limits, m["lang"].eqNullSafe(limits["_lang"]) & m["source"].eqNullSafe(limits["_source"]), "left")
    beyond = [_rate(r) > F.col(f"{r}_high") for r in RATES] + [_rate(r) < F.col(f"{r}_low") for r in RATES if RATES[r][4]]
    verdict = ~reduce(lambda a, b: a | b, [F.coalesce(x, F.lit(False)) for x in beyond])
    return joined.select("doc_id", "lang", "source", *NAMES, "base_failed",
                         (~F.col("base_failed") & verdict).alias("kept"))


def _oracle(reach: int = 8, prior: int = 50) -> str:
    rates = {r: f"(({v[2]} * {v[0]}) // greatest({v[1]}, 1))" for r, v in RATES.items()}
    buckets = " UNION ALL ".join(
        f"SELECT lang, source, '{r}' AS rate, ((v >> s) << s) AS bucket FROM (SELECT lang, source, {e} AS v, "
        f"CAST(greatest(length(bin({e})) - 7, 0) AS BIGINT) AS s FROM m WHERE NOT base_failed)" for r, e in rates.items())

    def fence(r: str, end: str) -> str:
        spread, slack = f"{reach} * (q3 - q1)", RATES[r][3]
        value = f"q3 + greatest({spread}, 2 * (q90 - q3), {slack})" if end == "high" else f"q1 - greatest({spread}, {slack})"
        return f"max({value}) FILTER (rate = '{r}') AS {r}_{end}"

    ends = [(r, "high") for r in RATES] + [(r, "low") for r in RATES if RATES[r][4]]
    cols = ", ".join(fence(r, e) for r, e in ends)
    half = prior * UNIT // 2

    def shares(keys: str) -> str:
        return (f"SELECT {keys} rate, bucket, ({half} * n) // sum(n) OVER (PARTITION BY {keys} rate) AS weight "
                f"FROM (SELECT {keys} rate, bucket, count(*) AS n FROM b GROUP BY ALL)")

    pick = {(r, e): f"o.{r}_{e}" for r, e in ends}
    beyond = " OR ".join(f"coalesce({rates[r]} {'>' if e == 'high' else '<'} {pick[r, e]}, false)" for r, e in ends)
    return f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t,
       list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS k
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
rep AS (SELECT win.doc_id, win.i FROM win JOIN (SELECT doc_id, k FROM win GROUP BY ALL HAVING count(*) > 1) r
        ON win.doc_id = r.doc_id AND win.k = r.k),
rw AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) FILTER (filled) - count(DISTINCT line) FILTER (filled) AS dup FROM
       (SELECT doc_id, line, regexp_matches(line, '[^\\x20\\x09-\\x0D]') AS filled
        FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)) GROUP BY doc_id),
m0 AS (SELECT d.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
       CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
       CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
       CAST(length(regexp_replace(t, '[^\\x00-\\x08\\x0E-\\x1F\\x21-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]', '', 'g')) AS BIGINT) AS n_marks,
       CAST(len(string_split(t, chr(10))) AS BIGINT) AS n_lines,
       coalesce(ln.dup, 0) AS n_dup_lines, coalesce(rw.n, 0) AS n_repeat_words
       FROM d LEFT JOIN rw ON d.doc_id = rw.doc_id LEFT JOIN ln ON d.doc_id = ln.doc_id),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m0),
b AS ({buckets}),
g AS (SELECT DISTINCT lang, source, rate FROM b),
bl AS (SELECT lang, source, rate, bucket, sum(weight) AS weight FROM (
         SELECT lang, source, rate, bucket, count(*) * {UNIT} AS weight FROM b GROUP BY ALL
         UNION ALL SELECT g.lang, g.source, g.rate, l.bucket, l.weight FROM g JOIN ({shares('lang,')}) l
                   ON g.lang IS NOT DISTINCT FROM l.lang AND g.rate = l.rate
         UNION ALL SELECT g.lang, g.source, g.rate, a.bucket, a.weight FROM g JOIN ({shares('')}) a ON g.rate = a.rate) GROUP BY ALL),
q AS (SELECT lang, source, rate, min(bucket) FILTER (4 * upto >= total) AS q1, min(bucket) FILTER (4 * upto >= 3 * total) AS q3,
             min(bucket) FILTER (10 * upto >= 9 * total) AS q90
      FROM (SELECT *, sum(weight) OVER (PARTITION BY lang, source, rate) AS total,
                   sum(weight) OVER (PARTITION BY lang, source, rate ORDER BY bucket) AS upto FROM bl) GROUP BY ALL),
o AS (SELECT lang, source, {cols} FROM q GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({beyond}) AS kept
FROM m LEFT JOIN o ON m.lang IS NOT DISTINCT FROM o.lang AND m.source IS NOT DISTINCT FROM o.source
"""


ORACLE = _oracle()
