"""Units kept between triggers: only the places that changed are clustered again (ST2).

``refresh_changed_units`` is a ``foreachBatch`` body over the stream of stored pings.
It gives the units of the live window exactly as clustering the whole window would.

Occupied cells of the clustering grid that can hold neighbours (the 20 cells around one)
form islands.  Whatever decides on a ping (its neighbours, its cluster, the label of that
cluster, the core it borders on) lies in its own island, for any ``min_points``.  So a
trigger finds the cells that gained or lost pings, takes the islands they lie in or
next to, clusters the live pings of these alone and joins the result to the units of
all other islands, which keep their labels.  Cluster numbers are ranks of labels in
the route and are given again, over the units only.

Kept under ``root``: ``window`` (the live pings, by hour, batch and class of route),
``cells`` (route, cell, island) and ``units``, a snapshot of both per trigger that changed
something.  A trigger reads the snapshot before it and replaces what an earlier try of
its own batch left.  The clock is the newest instant seen, so it never goes back; a
late ping still inside the window is taken, an older one is not live.  Rows without an
instant, a route or a position are no stored pings and are left out, an empty batch
changes nothing, and columns other than those of a ping are ignored.  The ping ids of the
stream are unique; a ping sent again has the same place and counts once.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pingpath.config import Params
from pingpath.operators import cluster
from pingpath.operators.components import connected_components
from pingpath.session import materialise
from pingpath.sources.tables import PING_COLUMNS, with_xy
from pingpath.streaming.live_stream import HOUR_US, _put, _struct, _versions, expire

LIVE = _struct(ping_id=T.LongType(), session_hash=T.StringType(), route_id=T.IntegerType(), lon=T.DoubleType(),
               lat=T.DoubleType(), ts=T.TimestampNTZType(), x=T.DoubleType(), y=T.DoubleType())
CELLS = _struct(route_id=T.IntegerType(), cx=T.LongType(), cy=T.LongType(), island=T.LongType())
UNITS = _struct(route_id=T.IntegerType(), cluster_id=T.IntegerType(), lon=T.DoubleType(), lat=T.DoubleType(),
                report_count=T.LongType(), session_count=T.LongType(), last_ts=T.TimestampNTZType(), label=T.LongType(),
                island=T.LongType(), as_of=T.TimestampNTZType())
CELL = ["route_id", "cx", "cy"]


def _snapshots(spark: SparkSession, root: str) -> list[int]:
    """Batches that left a snapshot, oldest first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/units")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    return sorted(int(s.getPath().getName()[6:]) for s in fs.listStatus(path) if s.getPath().getName().startswith("batch="))


def _snapshot(spark: SparkSession, root: str, table: str, batch: int | None, schema: T.StructType) -> DataFrame:
    if batch is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/{table}/batch={batch}")


def _around(cells: DataFrame) -> DataFrame:
    """The cells and every cell that can hold a neighbour of theirs."""
    offsets = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
                                  for dx, dy in [(0, 0), *cluster.ALL_OFFSETS]]))
    return cells.select(*CELL, offsets.alias("o")).select(
        "route_id", (F.col("cx") + F.col("o.dx")).alias("cx"), (F.col("cy") + F.col("o.dy")).alias("cy")).distinct()


def islands(pings: DataFrame) -> DataFrame:
    """(route_id, cx, cy, island): occupied cells with the least ping id of their island."""
    cells = materialise(pings.groupBy(*CELL).agg(F.min("ping_id").alias("node")), "island-cells")
    offsets = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in cluster.FORWARD_OFFSETS]))
    near = cells.select("route_id", "cx", "cy", F.col("node").alias("src"), offsets.alias("o")).select(
        "route_id", (F.col("cx") + F.col("o.dx")).alias("cx"), (F.col("cy") + F.col("o.dy")).alias("cy"), "src")
    edges = near.join(cells.withColumnRenamed("node", "dst"), CELL).select("src", "dst")
    return cells.join(connected_components(edges), "node", "left").select(*CELL, F.coalesce("label", "node").alias("island"))


def refresh_changed_units(spark: SparkSession, root: str, routes: DataFrame, params: Params,
                          clustered: list[int] | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch body; ``clustered`` gets the number of pings clustered by each trigger."""
    side = params.eps_m / math.sqrt(2.0)
    span = dt.timedelta(seconds=params.live_window_s)

    def celled(rows: DataFrame) -> DataFrame:
        return rows.withColumn("cx", F.floor(F.col("x") / side)).withColumn("cy", F.floor(F.col("y") / side))

    def body(batch: DataFrame, batch_id: int) -> None:
        last = max((b for b in _snapshots(spark, root) if b < batch_id), default=None)
        cells, units = _snapshot(spark, root, "cells", last, CELLS), _snapshot(spark, root, "units", last, UNITS)
        clock = None if last is None else units.agg(F.max("as_of")).first()[0]
        as_of = max((t for t in (clock, batch.agg(F.max("ts")).first()[0]) if t is not None), default=None)
        if as_of is None or (as_of == clock and batch.isEmpty()):
            return
        lower = as_of - span
        rows = batch.where(F.col("ts") >= F.lit(lower)).dropna(subset=["ping_id", "lon", "lat"])
        rows = with_xy(rows.select(*PING_COLUMNS)).join(routes.where("active").select("route_id"), "route_id", "left_semi")
        _put(rows, f"{root}/window", batch_id, LIVE, "ts", "route_id")

        since = lower if clock is None else min(lower, clock - span)
        hour = (since - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=HOUR_US)
        kept = celled(_versions(spark, f"{root}/window", LIVE)
                      .where((F.col("hour") >= hour) & (F.col("batch") <= batch_id) & (F.col("ts") >= F.lit(since))))
        gained, lost = F.col("batch") == batch_id, F.col("ts") < F.lit(lower)
        changed = materialise(kept.where(gained | lost).select(*CELL).distinct(), "changed-cells")
        touched = materialise(cells.join(_around(changed), CELL, "left_semi").select("island").distinct(), "touched-islands")
        places = cells.join(touched, "island", "left_semi").select(*CELL).unionByName(changed).distinct()
        part = materialise(kept.where(~lost).join(places, CELL, "left_semi").drop("class", "hour", "batch")
                           .dropDuplicates(["ping_id"]), "changed-pings")
        if clustered is not None:
            clustered.append(part.count())

        fresh = materialise(islands(part), "new-islands")
        found, _ = cluster.detect_units(part.drop("cx", "cy"), params.eps_m, params.min_points, ["route_id"])
        home = part.select(F.col("ping_id").alias("label"), *CELL).join(fresh, CELL).select("label", "island")
        found = found.join(home, "label")
        keep = units.where(F.col("label").isNotNull()).join(touched, "island", "left_anti")
        rank = Window.partitionBy("route_id").orderBy("label")
        now = (keep.drop("as_of", "cluster_id").unionByName(found.drop("cluster_id"))
               .withColumn("cluster_id", (F.row_number().over(rank) - 1).cast("int")))
        mark = spark.createDataFrame([(as_of,)], "as_of timestamp_ntz")  # stays when there are no units
        out = now.withColumn("as_of", F.lit(as_of)).unionByName(mark, allowMissingColumns=True)
        (cells.join(touched, "island", "left_anti").unionByName(fresh)
         .select(*CELLS.fieldNames()).write.mode("overwrite").parquet(f"{root}/cells/batch={batch_id}"))
        out.select(*UNITS.fieldNames()).write.mode("overwrite").parquet(f"{root}/units/batch={batch_id}")

    return body


def live_units(spark: SparkSession, root: str) -> DataFrame:
    """The units of the newest snapshot, with the clock they were taken at."""
    batches = _snapshots(spark, root)
    return (_snapshot(spark, root, "units", batches[-1] if batches else None, UNITS)
            .where(F.col("label").isNotNull()).drop("island"))


def start(pings: DataFrame, body: Callable[[DataFrame, int], None], progress: str, every: str = "30 seconds") -> StreamingQuery:
    """Run the body over a stream of stored pings, a trigger every 30 s as the service's page asks for."""
    return (pings.writeStream.foreachBatch(body).option("checkpointLocation", progress)
            .trigger(processingTime=every).start())


def expire_window(spark: SparkSession, root: str, params: Params, keep: int = 2) -> int:
    """Remove the hours before the live window and all but the newest ``keep`` snapshots; returns how many folders went.

    To be called between triggers, or from the body of the next one.
    """
    batches = _snapshots(spark, root)
    if not batches:
        return 0
    as_of = _snapshot(spark, root, "units", batches[-1], UNITS).agg(F.max("as_of")).first()[0]
    # the next trigger still reads what leaves the window: hours that end before the window began
    gone = expire(spark, root, as_of - dt.timedelta(seconds=params.live_window_s), ("window",))
    for table in ("units", "cells"):
        for old in batches[:-keep]:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{table}/batch={old}")
            gone += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return gone
