"""Line dedup: first occurrences of lines by range-partitioned hashes, as keep bitmaps.

A line's key is the line without ASCII blanks at both ends, A-Z lower-cased.
Of a key of at least ``min_chars`` code points that several documents hold, only
the lines of the smallest doc_id stay.

Everything is DataFrame operations.  Lines become 128-bit key hashes, document id
and position; texts are not shuffled for the search.  Two streaming passes:

1. Rows are range-partitioned by (hash, band), a band being a hash class of
   document ids, and sorted by document and position within each.  A running
   minimum streams each group: rows of later documents than its first go, for
   good.  A hash that holds a third of all lines is spread over its bands.
2. The first occurrences of the bands, at most ``bands`` documents a hash, are
   sorted by document and position once more; all but the first document's go.

Lines that go are folded into bitmaps, 64 lines a word.  Only words with a line
that goes are kept, so the bitmap of a document costs what its duplicates cost;
a document without any has none.  ``apply_bitmaps`` cuts texts with them.

Defined cases: a null or empty text is one empty line; a document with a null
doc_id takes no part and keeps its lines; rows that repeat a doc_id are one
document for the search, and each row is cut by the bitmap of its own text; only
doc_id and text are read, so extra columns cannot clash; an empty table gives an
empty result.  Texts and lines of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pingpath.llm.common import lower_ascii

#: [\\x20\\x09-\\x0D]: the characters stripped from lines (fixed value).
BLANKS = " \t\n\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _tag(text: Column) -> Column:
    """Upper half of a long that tells the texts under one doc_id apart."""
    return F.shiftleft(F.shiftright(F.xxhash64(F.coalesce(text, F.lit(""))), 32), 32)


def dropped_lines(docs: DataFrame, min_chars: int = 10, bands: int = 64) -> DataFrame:
    """(doc_id, at): lines that go; ``at`` is the text's tag plus the line's position."""
    # The tag is computed below the explode, once a text; no line carries its text.
    lines = (docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text", _tag(F.col("text")).alias("tag"))
             .select("doc_id", "tag", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
             .select("doc_id", F.col("tag").bitwiseOR(F.col("pos")).alias("at"),
                     lower_ascii(F.btrim("line", F.lit(BLANKS))).alias("key"))
             .where(F.length("key") >= min_chars)
             .select("doc_id", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"),
                     F.pmod(F.xxhash64("doc_id"), F.lit(bands)).cast("int").alias("band")))

    in_band = Window.partitionBy("h1", "h2", "band").orderBy("doc_id", "at")
    once = (lines.repartitionByRange("h1", "h2", "band")
            .withColumn("late", F.col("doc_id") > F.min("doc_id").over(in_band)))
    # Rows already known to go are dealt out by document, so no key gathers them again.
    first = once.select("doc_id", "at", "late",
                        F.when(F.col("late"), F.xxhash64("doc_id", "at")).otherwise(F.col("h1")).alias("h1"),
                        F.when(~F.col("late"), F.col("h2")).alias("h2"))
    in_all = Window.partitionBy("late", "h1", "h2").orderBy("doc_id", "at")
    return (first.withColumn("goes", F.col("late") | (F.col("doc_id") > F.min("doc_id").over(in_all)))
            .where("goes").select("doc_id", "at"))


def keep_bitmaps(docs: DataFrame, min_chars: int = 10, bands: int = 64) -> DataFrame:
    """(doc_id, tag, keep) of the texts with lines to drop.

    ``keep`` is an array of (word, bits): bit i of word w is set if line 64 w + i
    stays.  Words whose lines all stay are left out.
    """
    at = F.col("at")
    words = (dropped_lines(docs, min_chars, bands)
             .groupBy("doc_id", F.shiftleft(F.shiftright(at, 32), 32).alias("tag"),
                      F.shiftright(at.bitwiseAND(F.lit(0xFFFFFFFF)), 6).cast("int").alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("gone")))
    return (words.groupBy("doc_id", "tag")
            .agg(F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("bits")))).alias("keep")))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Columns of ``docs`` with the dropped lines cut from ``text``, n_lines and n_dropped."""
    b = bitmaps.select(F.col("doc_id").alias("_doc_id"), F.col("tag").alias("_tag"), F.col("keep").alias("_keep"))
    joined = docs.join(b, (docs["doc_id"] == b["_doc_id"]) & (_tag(docs["text"]) == b["_tag"]), "left")
    # Runs of words that all stay fill the gaps between the kept ones, in order: linear in the text.
    full = F.lit(-1).cast("long")
    words = F.flatten(F.transform("_keep", lambda k, i: F.concat(
        F.array_repeat(full, k["word"] - F.when(i == 0, 0).otherwise(F.get("_keep", i - 1)["word"] + 1)), F.array(k["bits"]))))
    cut = F.expr("""array_join(filter(split(coalesce(text, ''), '\n', -1), (line, i) ->
        i >= 64 * size(`_words of text`) OR getbit(`_words of text`[shiftright(i, 6)], i & 63) = 1), '\n')""")
    return (joined.withColumn("_words of text", F.when(F.col("_keep").isNotNull(), words))
            .select(*[docs[c] for c in docs.columns if c != "text"],
                    F.when(F.col("_keep").isNull(), F.coalesce("text", F.lit(""))).otherwise(cut).alias("text"),
                    F.size(_lines(F.col("text"))).cast("long").alias("n_lines"),
                    F.coalesce(F.aggregate("_keep", F.lit(0).cast("long"),
                                           lambda n, k: n + F.bit_count(F.bitwise_not(k["bits"]))),
                               F.lit(0).cast("long")).alias("n_dropped")))


ORACLE = """
WITH l AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
      FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
o AS (SELECT k, min(doc_id) AS owner FROM l WHERE length(k) >= 10 GROUP BY k),
x AS (SELECT l.*, o.owner IS NOT NULL AND l.doc_id <> o.owner AS gone FROM l LEFT JOIN o ON l.k = o.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM x GROUP BY doc_id
"""
