"""Removing rows from a month-partitioned store, safely against a job that dies midway.

Only files that hold a row to remove change.  Their other rows are written into the
store's ``_change`` folder, which readers do not see; then a journal names the files that
go.  From there on the change is decided: new files move in, old ones are removed, and
each step can be done again.  ``finish`` completes a decided change and discards an
undecided one, so whoever runs next finds all kept rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pingpath.sources.tables import STORE, read_pings, write_pings


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _write_journal(spark: SparkSession, path: str, gone: list[str]) -> None:
    fs, draft = _fs(spark, f"{path}/_change/journal")
    out = fs.create(draft, True)
    out.write(bytearray("\n".join(gone).encode("utf-8")))
    out.close()
    fs.rename(draft, _fs(spark, f"{path}/_change/decided")[1])


def _move_in(spark: SparkSession, path: str) -> None:
    fs, new = _fs(spark, f"{path}/_change/new")
    if not fs.exists(new):
        return
    for month in fs.listStatus(new):
        if month.isDirectory():
            target = _fs(spark, f"{path}/{month.getPath().getName()}")[1]
            fs.mkdirs(target)
            for file in fs.listStatus(month.getPath()):
                fs.rename(file.getPath(), _fs(spark, f"{target.toString()}/{file.getPath().getName()}")[1])


def _remove(spark: SparkSession, path: str, gone: list[str]) -> None:
    for name in gone:
        fs, file = _fs(spark, name)
        fs.delete(file, False)
        folder = file.getParent()
        if fs.exists(folder) and not fs.listStatus(folder):
            fs.delete(folder, False)


def finish(spark: SparkSession, path: str) -> None:
    """Complete a change that was decided, discard one that was not."""
    fs, change = _fs(spark, f"{path}/_change")
    decided = f"{path}/_change/decided"
    if fs.exists(_fs(spark, decided)[1]):
        gone = [r["value"] for r in spark.read.text(decided).collect() if r["value"]]
        _move_in(spark, path)
        _remove(spark, path, gone)
    fs.delete(change, True)


def remove_rows(spark: SparkSession, path: str, drop: Column, within: Column | None = None) -> int:
    """Remove the rows for which ``drop`` is true; returns their number.

    One scan of the columns of ``drop`` counts rows to remove and to keep in each file;
    only files with both are read whole.  ``within`` limits the partitions looked at.
    The driver holds one row for each file that changes.
    """
    finish(spark, path)
    goes = F.coalesce(drop, F.lit(False))
    stored = read_pings(spark, path)
    if within is not None:
        stored = stored.where(within)
    files = (stored.groupBy(F.col("_metadata.file_path").alias("file"))
             .agg(F.count_if(goes).alias("gone"), F.count_if(~goes).alias("kept")).where("gone > 0").collect())
    if not files:
        return 0
    mixed = sorted(f["file"] for f in files if f["kept"])
    if mixed:
        rows: DataFrame = spark.read.schema(STORE).option("basePath", path).parquet(*mixed)
        write_pings(rows.where(~goes).drop("month"), f"{path}/_change/new", mode="overwrite")
    else:
        _fs(spark, path)[0].mkdirs(_fs(spark, f"{path}/_change")[1])
    _write_journal(spark, path, sorted(f["file"] for f in files))
    finish(spark, path)
    return sum(f["gone"] for f in files)
