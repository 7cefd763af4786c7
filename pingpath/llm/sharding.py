"""Sharding: best-fit-decreasing packing of indivisible groups into shards.

Documents of one text form a group that no shard boundary may cut; its size is
the sum of its documents' UTF-8 bytes plus one each.

Best fit looks at all open bins for every item, so it is done in levels.  Groups
are dealt by hash to tasks of about ``task_items`` groups; each sorts its groups
by size and puts each into the tightest bin that holds it, found in a balanced
tree.  Bins hold 1 / ``bins_per_shard`` of a shard.  Bins are the items of the
next level, until at most ``task_items`` are left; those few are packed into
shards on the driver: with ``capacity`` into as few shards of it as best fit
needs, with ``n_shards`` into that many shards of the least capacity that best
fit finds (law ``bytes``).  A level leaves at most two bins a bin's worth of bytes
and one a task, so ``task_items`` bounds every task and the driver at any input.

A group larger than a shard has a shard of its own.

Slots number the documents of a shard without gaps.  Hash classes of documents
are counted, the counts of the classes before give a class its first slot, and
rows are numbered by document id within the class, so no task sorts a shard.

Defined cases: null texts are empty (size 1, CRC-32 of nothing) and group with
empty texts; rows that repeat a document id each get a slot; rows with a null id
come first in their class; extra columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pingpath.llm.common import staged
from pingpath.llm.packing import best_fit_decreasing, pack_into

#: Documents numbered together within a shard.
SLOT_CLASS = 4096


def _sized(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    # Two texts of one hash would only be kept together, which breaks no law.
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("item"))


def _pack_level(items: DataFrame, tasks: int, capacity: int) -> DataFrame:
    """(item, size, bin): one level of packing, each task on its share of the items."""
    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["size", "item"], ascending=[False, True])
        bins = best_fit_decreasing(part["size"].tolist(), capacity)
        return pd.DataFrame({"item": part["item"], "size": part["size"], "bin": [(key[0] << 32) + b for b in bins]})

    return (items.withColumn("task", F.pmod(F.xxhash64("item"), F.lit(tasks)).cast("long"))
            .groupBy("task").applyInPandas(pack, "item long, size long, bin long"))


def assign_shards(sized: DataFrame, n_shards: int | None, capacity: int | None,
                  bins_per_shard: int = 64, task_items: int = 10_000) -> DataFrame:
    """(item, shard) for the groups of ``sized`` (item, size)."""
    spark = sized.sparkSession
    items = sized.groupBy("item").agg(F.sum("size").alias("size"))
    n, total = items.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    n_shards_about = n_shards or -(-total // capacity)
    task_items = max(task_items, 4 * n_shards_about)
    bins_per_shard = max(1, min(bins_per_shard, task_items // (4 * max(n_shards_about, 1))))
    share = max(1, (capacity or -(-total // n_shards)) // bins_per_shard)
    levels = []
    while n > task_items:
        packed = staged(_pack_level(items, -(-n // task_items), share), "shard-level")
        levels.append(packed)
        items = packed.groupBy(F.col("bin").alias("item")).agg(F.sum("size").alias("size"))
        n = items.count()
    top = sorted((r["item"], r["size"]) for r in items.collect())  # at most task_items rows
    sizes = [s for _, s in top]
    place = best_fit_decreasing(sizes, capacity) if capacity else pack_into(sizes, n_shards)
    shards = spark.createDataFrame([(i, s) for (i, _), s in zip(top, place, strict=True)], "item long, shard int")
    for packed in reversed(levels):
        shards = (packed.join(F.broadcast(shards) if packed is levels[-1] else shards,
                              packed["bin"] == shards["item"])
                  .select(packed["item"], "shard"))
    return shards


def shard(docs: DataFrame, n_shards: int | None = 8, capacity: int | None = None, **limits) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, one row per document row."""
    sized = staged(_sized(docs), "shard-sized")
    shards = assign_shards(sized.select("item", "size"), n_shards, capacity, **limits)
    classes = max(1, sized.count() // (SLOT_CLASS * (n_shards or 1)))
    placed = staged(sized.join(shards, "item").select(
        "doc_id", "size", "text_crc32", "shard",
        F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(classes)).cast("int").alias("part")), "shard-placed")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
              .select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    order = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32")
    return (placed.withColumn("at", F.row_number().over(order) - 1).join(firsts, ["shard", "part"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("first") + F.col("at")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
