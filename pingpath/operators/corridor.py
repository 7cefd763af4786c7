"""Distance from each ping to its route's line (J4) without a pings x segments join.

Every trace segment is registered in the grid cells that its corridor-wide buffer
touches; segments are folded into one array per (route, cell).  Cells are about as
long as a segment (and no smaller than the corridor).  Where a route's stops lie so
densely that a cell still holds more than ``LIST_SEGS`` segments, the parts of it that
have pings get lists of their own (``split_cells``): a part keeps the segments that are
the nearest one of some point of it, so a ping measures about as many segments however
dense its route's stops are, and finds the same distance.  Tables are written
once, so the planner broadcasts them while they are small: then the ping side is never
shuffled.  A ping whose cell holds no segment of its route is farther than the corridor
from every segment, so its distance is reported as NULL with ``beyond_corridor`` true.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pingpath.functions import geo
from pingpath.operators.traces import segments
from pingpath.session import materialise

#: Segments that a cell's list may hold before the cell is split; each split halves both sides twice.
LIST_SEGS = 32
MAX_DEPTH = 8
CELL = ["route_id", "depth", "gx", "gy"]


def segment_cells(stops: DataFrame, corridor_m: float, cell_m: float = 500.0) -> DataFrame:
    """(route_id, gx, gy, segs ARRAY<STRUCT<ax, ay, dx, dy, len2>>) for buffered segments."""
    pad = corridor_m * 1.01 + 1.0  # grid metres vs ellipsoidal metres differ < 0.1 %
    s = segments(stops)
    s = s.select(
        "route_id", "ax", "ay", "bx", "by",
        F.sequence(F.floor((F.least("ax", "bx") - pad) / cell_m), F.floor((F.greatest("ax", "bx") + pad) / cell_m)).alias("gxs"),
        F.sequence(F.floor((F.least("ay", "by") - pad) / cell_m), F.floor((F.greatest("ay", "by") + pad) / cell_m)).alias("gys"))
    s = s.select("*", F.explode("gxs").alias("gx")).select("*", F.explode("gys").alias("gy"))
    s = s.withColumn("dx", F.col("bx") - F.col("ax")).withColumn("dy", F.col("by") - F.col("ay"))
    s = s.withColumn("len2", F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    return s.groupBy("route_id", "gx", "gy").agg(
        F.collect_list(F.struct("ax", "ay", "dx", "dy", "len2")).alias("segs"))


def _squared(px: Column, py: Column, segs: str = "segs") -> Column:
    """Squared grid distances of point P to the segments, as ``geo.segment_grid_distance`` has them."""
    def along(s: Column) -> Column:
        t = F.when(s["len2"] > 0, ((px - s["ax"]) * s["dx"] + (py - s["ay"]) * s["dy"]) / s["len2"]).otherwise(F.lit(0.0))
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))

    def squared(s: Column, t: Column) -> Column:  # a lambda computes what it names anew each time, so t comes as a value
        x, y = px - (s["ax"] + t * s["dx"]), py - (s["ay"] + t * s["dy"])
        return x * x + y * y
    return F.zip_with(segs, F.transform(segs, along), squared)


def _at_depth(v: str, cell_m: float) -> Column:
    """Index of the cell at ``depth`` splits; a split divides by four, so it is the parent's index times four and up."""
    return F.floor(F.col(v) / cell_m * F.pow(F.lit(4.0), F.col("depth")))


def split_cells(cells: DataFrame, pings: DataFrame, cell_m: float, deepest: int) -> DataFrame:
    """The lists of the parts (route_id, depth, gx, gy) that ``pings`` (with their ``depth``) lie in.

    From the middle of a part no point of it is farther than half a diagonal.  So the
    nearest segment of any of its points is at most a diagonal farther from the middle than
    the middle's nearest one, and all others leave the list.
    """
    used = materialise(pings.where("depth > 0").select(*CELL).distinct(), "corridor-parts")
    found, lists = cells.where("depth = 0").select(*CELL, "segs"), cells.where("depth > 0")
    tasks = int(pings.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much to measure: shared by a number given
    for level in range(1, deepest + 1):
        side = cell_m / 4.0 ** level
        up = F.pow(F.lit(4.0), F.col("depth") - level)
        here = (used.where(F.col("depth") >= level)
                .select("route_id", "depth", *[F.floor(F.col(g) / up).alias(g) for g in ("gx", "gy")]).distinct()
                .repartition(tasks, *CELL))
        # dealt out on both sides: whichever is broadcast, the other one's tasks share the measuring
        parent = (lists.where(F.col("depth") >= level).withColumnsRenamed({"gx": "ux", "gy": "uy"})
                  .repartition(tasks, "route_id", "depth", "ux", "uy"))
        part = here.withColumn("ux", F.floor(F.col("gx") / 4)).withColumn("uy", F.floor(F.col("gy") / 4)).join(
            parent, ["route_id", "depth", "ux", "uy"])
        part = part.withColumn("far", F.transform(
            _squared((F.col("gx") + 0.5) * side, (F.col("gy") + 0.5) * side), lambda d: F.sqrt(d)))
        reach = F.array_min("far") + (side * math.sqrt(2.0) + 1e-6)  # metres; covers rounding
        near = F.filter("segs", lambda s, i: F.col("far")[i] <= F.col("reach"))
        lists = materialise(part.withColumn("reach", reach).select(*CELL, near.alias("segs")), "corridor-lists")
        found = found.unionByName(lists.where(F.col("depth") == level))
    return materialise(found, "corridor-found")


def routes_with_trace(stops: DataFrame) -> DataFrame:
    return stops.groupBy("route_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("route_id")


def cell_size(stops: DataFrame, corridor_m: float) -> float:
    """Median segment length, at least the corridor: one number of the whole table."""
    length = F.sqrt((F.col("bx") - F.col("ax")) ** 2 + (F.col("by") - F.col("ay")) ** 2)
    middle = segments(stops).agg(F.percentile_approx(length, 0.5)).first()[0]
    return max(float(corridor_m), float(middle or 0.0))


def near_segments(pings: DataFrame, stops: DataFrame, corridor_m: float, cell_m: float | None = None,
                  list_segs: int = LIST_SEGS) -> DataFrame:
    """Adds x, y (UTM) and ``segs``: the nearest segment is among them if one is within the corridor, NULL if none is near."""
    cell_m = cell_m or cell_size(stops, corridor_m)
    splits = F.ceil(F.log2(F.size("segs") / F.lit(float(list_segs))) / 2.0)
    cells = materialise(segment_cells(stops, corridor_m, cell_m).withColumn(
        "depth", F.least(F.greatest(splits, F.lit(0)), F.lit(MAX_DEPTH)).cast("int")), "corridor-cells")
    deepest = cells.agg(F.max("depth")).first()[0] or 0
    p = geo.add_utm(pings, "lon", "lat", "x", "y")
    p = (p.withColumn("gx", F.floor(F.col("x") / cell_m))
         .withColumn("gy", F.floor(F.col("y") / cell_m)))
    if not deepest:
        return p.join(cells.drop("depth"), ["route_id", "gx", "gy"], "left").drop("gx", "gy")
    depths = cells.where("depth > 0").select("route_id", "gx", "gy", "depth")
    p = p.join(depths, ["route_id", "gx", "gy"], "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    tasks = int(pings.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as many files, for as many tasks to measure
    p = materialise(p.withColumn("gx", _at_depth("x", cell_m)).withColumn("gy", _at_depth("y", cell_m)).repartition(tasks), "corridor-pings")
    return p.join(split_cells(cells, p, cell_m, deepest), CELL, "left").drop("depth", "gx", "gy")


def distance_to_trace(pings: DataFrame, stops: DataFrame, corridor_m: float = 100.0,
                      cell_m: float | None = None, list_segs: int = LIST_SEGS) -> DataFrame:
    """Adds x, y (UTM), has_trace, trace_distance_m (NULL when none is near) and beyond_corridor.

    ``pings`` needs route_id, lon, lat.  The result keeps every input row.
    """
    traced = materialise(routes_with_trace(stops).withColumn("has_trace", F.lit(True)), "corridor-traced")
    p = near_segments(pings, stops, corridor_m, cell_m, list_segs).join(traced, "route_id", "left")
    px, py, plat = F.col("x"), F.col("y"), F.col("lat")
    # the scale factor is taken at the ping, so it leaves the per-segment lambda
    grid = F.sqrt(F.array_min(_squared(px, py)))
    dist = grid / geo.point_scale(px, plat)
    has = F.coalesce(F.col("has_trace"), F.lit(False))
    out = p.withColumn("has_trace", has).withColumn("trace_distance_m", dist)
    out = out.withColumn("beyond_corridor",
                         has & F.coalesce(F.col("trace_distance_m") > corridor_m, F.lit(True)))
    return out.drop("segs")
