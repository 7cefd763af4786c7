"""Shared helpers of the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pingpath.session import ensure_checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Text handled at once by a vectorised mapper; its temporaries are some 100 times that.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    Cuts lineage like ``checkpoint()`` does, but stays columnar, so later reads
    prune columns; what is read back survives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.staged_path = path
    return table


def forget(*tables: DataFrame) -> None:
    """Remove staged tables that nothing reads any more; whatever was made from them must be staged itself."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.staged_path)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Ids that may be broadcast (about 120 bytes each once hashed, 30 MB); more are joined by shuffling both sides.
MAX_BROADCAST_IDS = 250_000


def few(rows: DataFrame, name: str, weight: Column | None = None) -> DataFrame:
    """``rows`` staged, marked for broadcast if their counted weight (rows, or the sum of ``weight``) allows."""
    kept = staged(rows, name)
    total = kept.agg(F.sum(F.lit(1) if weight is None else weight)).first()[0] or 0
    if total > MAX_BROADCAST_IDS:
        return kept
    marked = F.broadcast(kept)
    marked.staged_path = kept.staged_path
    return marked


def by_id(ids: DataFrame, name: str) -> DataFrame:
    """A table of ids to pick documents by: while it is few, picking moves no text."""
    return few(ids, name)


def lower_ascii(c: Column) -> Column:
    """A-Z lowered, everything else as it is; all-ASCII strings take the fast built-in."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))
