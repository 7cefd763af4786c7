"""Small hard tables for the training-data operators."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

#: Extra columns whose names clash with those that operators make inside.
CLASH = ["size", "item", "band", "h1", "late", "region", "id", "n_words", "hash", "row", "_id", "_bad", "_lost",
         "label", "score", "part", "shard", "budget", "feature", "key", "tag", "at", "links", "root"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng: random.Random, n: int, words: int = 400) -> str:
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def odd_rows() -> list[tuple]:
    rng = random.Random(3)
    plain = sentence(rng, 120)
    long = sentence(rng, 60_000, 5_000)
    rows = [
        (1, plain, "en", "a"), (2, plain, "en", "a"), (2, plain, "en", "a"),           # copies, a repeated row
        (3, None, "en", "a"), (4, "", "en", None), (5, " \n\t\n ", None, "b"), (6, "one", "en", "b"), (7, "One two", "en", "b"),
        (8, long, "de", "b"), (9, long + " tail", "de", "b"),                           # near copies, very long
        (None, plain, "en", "a"), (None, None, None, None), (10, "tied line of text\n" * 40, "fr", "a"),
        (11, "Tied line of text  \nown words here now\n\nTIED LINE OF TEXT", "fr", "a"),
        (12, "é" * 3000 + " ü ß \U0001f600 x\x00y", "fr", "c"), (13, "you idiot scum " + plain, "en", "a"),
        (14, "idiot", "en", "a"), (15, "a" * 100_000, "en", "c"),
    ]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


def frame(spark: SparkSession, rows: list[tuple], extras: bool = True) -> DataFrame:
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    if not extras:
        return spark.createDataFrame(rows, SCHEMA)
    schema = SCHEMA + "".join(f", {c} string" for c in CLASH if c not in names)
    return spark.createDataFrame([(*r, *["x"] * len(CLASH)) for r in rows], schema)


def odd_documents(spark: SparkSession) -> DataFrame:
    return frame(spark, odd_rows())


def no_documents(spark: SparkSession) -> DataFrame:
    return frame(spark, [])


def rows_of(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=str)
