"""Session helpers: building a local session, checkpoint folder, checked broadcast."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def build_session(master: str | None = None, app: str = "pingpath",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Session for tests and the bench (local mode). Clusters bring their own."""
    master = master or os.environ.get("PINGPATH_MASTER", "local[8]")
    cores = master[master.find("[") + 1:-1] if "[" in master else "8"
    parts = shuffle_partitions or (8 if cores in ("*", "") else max(int(cores), 1))
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("PINGPATH_DRIVER_MEM", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting one only when unset.

    On a cluster ``spark.checkpoint.dir`` must name a shared folder (HDFS, object
    store).  Only a local-mode session without that setting (tests, the bench)
    gets a fresh temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; iterative jobs need a shared folder")
    path = tempfile.mkdtemp(prefix="pingpath-ckpt-", dir="/tmp")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss) in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_STAGED = threading.local()


@contextmanager
def staged(spark: SparkSession) -> Iterator[None]:
    """The tables that ``materialise`` writes in this block (and thread) are removed at its end; no result may need them then."""
    outer, _STAGED.paths = getattr(_STAGED, "paths", None), []
    try:
        yield
    finally:
        paths, _STAGED.paths = _STAGED.paths, outer
        for path in map(spark._jvm.org.apache.hadoop.fs.Path, paths):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str, schema: StructType | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts lineage like a reliable checkpoint, but columnar: later reads prune
    columns.  The planner knows the bytes of what it reads back, so it broadcasts
    a dimension exactly while that is below its threshold and shuffles otherwise.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if getattr(_STAGED, "paths", None) is not None:
        _STAGED.paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)
