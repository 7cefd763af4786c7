"""Density clustering of pings into vehicles (DBSCAN on a grid, A3/A4/A12/A13).

DBSCAN with radius ``eps`` metres and ``min_points`` (self included) over UTM
coordinates, independently per group of ``keys`` (route, or route and day).

Plan, all DataFrame work:

1. Take the stored UTM position (or project once); collapse pings at the same position of a group into
   weighted positions (a parked vehicle reporting thousands of times is one row).
2. Grid cells of side eps/sqrt(2): any two positions in a cell are within eps,
   so a cell with at least ``min_points`` pings is all core.  Only positions in
   sparse cells (fewer than ``min_points`` pings) count neighbours, over the 20
   cells of the 5x5 block without centre and corners; that work is bounded by
   ``min_points`` times the neighbour cells' size.
3. Cells over the 10 "forward" neighbour offsets are connected where a core
   position of one lies within eps of one of the other (``cell_components``);
   connected components over cells (components.py) give clusters.  A cluster's label is its smallest core ping id.
4. Border positions (not core, within eps of a core) join the cluster with the
   smallest label; the rest is noise.  With min_points = 2 there are no border
   positions.
5. ``cluster_id`` = dense rank of the label inside the group, from 0.

Equi-joins on (keys, cell) only; no theta or cross joins.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pingpath.functions import geo
from pingpath.operators.components import connected_components
from pingpath.session import cut_lineage
from pingpath.sources.tables import with_xy

# 5x5 block minus centre and corners; FORWARD is one of each +/- pair.
ALL_OFFSETS = [(dx, dy) for dx in range(-2, 3) for dy in range(-2, 3)
               if (dx, dy) != (0, 0) and not (abs(dx) == 2 and abs(dy) == 2)]
FORWARD_OFFSETS = [(dx, dy) for dx, dy in ALL_OFFSETS if dx > 0 or (dx == 0 and dy > 0)]


def _offsets(offsets) -> "F.Column":
    return F.explode(F.array(*[
        F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in offsets]))


def _neighbour_pairs(left: DataFrame, right: DataFrame, keys: list[str], offsets,
                     eps: float) -> DataFrame:
    """Pairs (left, right) of positions in offset cells with distance <= eps."""
    probe = (left.select(*keys, "cx", "cy", *[F.col(c).alias("l_" + c) for c in ("x", "y", "rep", "w")],
                         _offsets(offsets).alias("o"))
             .select(*keys, (F.col("cx") + F.col("o.dx")).alias("cx"),
                     (F.col("cy") + F.col("o.dy")).alias("cy"),
                     "l_x", "l_y", "l_rep", "l_w",
                     F.col("cx").alias("l_cx"), F.col("cy").alias("l_cy")))
    target = right.select(*keys, "cx", "cy", *[F.col(c).alias("r_" + c) for c in ("x", "y", "rep", "w")])
    joined = probe.join(target, keys + ["cx", "cy"])
    dx = F.col("l_x") - F.col("r_x")
    dy = F.col("l_y") - F.col("r_y")
    return joined.where(dx * dx + dy * dy <= F.lit(eps * eps))


SUB = 4  # boxes per cell side for the edge pre-test; each further step has four times as many
FINEST = SUB ** 10
#: Positions are compared once the pairs left are at most this many a position.
PAIRS_PER_ROW = 16


def _boxes(pts: DataFrame, side: float, parts: int) -> DataFrame:
    """Positions with their box (ix, iy) of ``parts`` x ``parts`` in their cell."""
    def index(v: str, c: str):
        i = F.floor((F.col(v) - F.col(c) * side) * (parts / side)).cast("long")
        return F.least(F.greatest(i, F.lit(0)), F.lit(parts - 1))
    return pts.withColumn("ix", index("x", "cx")).withColumn("iy", index("y", "cy"))


def _box_pairs(pairs: DataFrame, side: float, parts: int, eps: float) -> DataFrame:
    """Box pairs (a_ix, a_iy, b_ix, b_iy at cell offset dx, dy) that may hold an edge, with ``sure``."""
    t, guard = side / parts, 1e-6  # metres; covers rounding of positions that sit on a box border
    gx = F.abs(F.col("dx") * parts + F.col("b_ix") - F.col("a_ix"))
    gy = F.abs(F.col("dy") * parts + F.col("b_iy") - F.col("a_iy"))
    near = lambda g: F.greatest(g - 1, F.lit(0)) * t
    far = lambda g: (g + 1) * t
    return (pairs.where(near(gx) * near(gx) + near(gy) * near(gy) <= (eps + guard) ** 2)
            .withColumn("sure", far(gx) * far(gx) + far(gy) * far(gy) <= (eps - guard) ** 2))


def _relabel(comp: DataFrame, edges: DataFrame) -> DataFrame:
    """Components (node, label) after joining the components that ``edges`` (src, dst labels) connect."""
    more = connected_components(edges).select(F.col("node").alias("_old"), F.col("label").alias("_new"))
    nodes = comp.unionByName(more.select(F.col("_old").alias("node"), F.col("_old").alias("label"))).groupBy("node").agg(
        F.min("label").alias("label"))
    return cut_lineage(nodes.join(more, nodes["label"] == more["_old"], "left").select(
        "node", F.coalesce("_new", "label").alias("label")))


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Box pairs whose cells are not connected yet, with the cells' labels la and lb."""
    a = comp.select(F.col("node").alias("a"), F.col("label").alias("_la"))
    b = comp.select(F.col("node").alias("b"), F.col("label").alias("_lb"))
    return (pairs.join(a, "a", "left").join(b, "b", "left")
            .withColumn("la", F.coalesce("_la", "a")).withColumn("lb", F.coalesce("_lb", "b"))
            .where(F.col("la") != F.col("lb")).drop("_la", "_lb"))


def cell_components(core: DataFrame, keys: list[str], side: float, eps: float,
                    compared: list[int] | None = None) -> DataFrame:
    """(node, label): cells with core positions (by their least ping id) and their component.

    Cells split into boxes; two boxes entirely within eps of each other prove an edge
    without comparing positions, two boxes beyond eps exclude one.  Components are
    formed from the sure edges first, and box pairs between cells of one component
    need no work: in a dense strip that is nearly all of them.  What is left is split
    into finer boxes while its pairs of positions outnumber the positions by far,
    connecting after each step, and only then compared.  ``compared`` gets the number
    of position pairs compared.
    """
    parts = SUB
    pts = core.select(*keys, "cx", "cy", "x", "y", F.col("cell_rep").alias("rep"))
    boxed = _boxes(pts, side, parts)
    box = boxed.select(*keys, "cx", "cy", "rep", "ix", "iy").distinct()
    left = box.select(*keys, F.col("rep").alias("a"), F.col("ix").alias("a_ix"), F.col("iy").alias("a_iy"),
                      _offsets(FORWARD_OFFSETS).alias("o"), "cx", "cy").select(
        *keys, "a", "a_ix", "a_iy", F.col("o.dx").alias("dx"), F.col("o.dy").alias("dy"),
        (F.col("cx") + F.col("o.dx")).alias("cx"), (F.col("cy") + F.col("o.dy")).alias("cy"))
    right = box.select(*keys, "cx", "cy", F.col("rep").alias("b"), F.col("ix").alias("b_ix"), F.col("iy").alias("b_iy"))
    pairs = cut_lineage(_box_pairs(left.join(right, keys + ["cx", "cy"]), side, parts, eps)
                        .select("a", "a_ix", "a_iy", "b", "b_ix", "b_iy", "dx", "dy", "sure"))
    comp = connected_components(pairs.where("sure").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
    pts = pts.select("rep", "cx", "cy", "x", "y")
    while True:
        unsure = cut_lineage(_apart(pairs.where(~F.col("sure")), comp))
        if unsure.isEmpty():
            return comp
        here = _boxes(pts, side, parts)
        count = here.groupBy("rep", "ix", "iy").agg(F.count(F.lit(1)).alias("n"))
        work = (unsure.join(count.toDF("a", "a_ix", "a_iy", "na"), ["a", "a_ix", "a_iy"])
                .join(count.toDF("b", "b_ix", "b_iy", "nb"), ["b", "b_ix", "b_iy"])
                .agg(F.sum(F.col("na") * F.col("nb")).alias("pairs"), F.sum(F.col("na") + F.col("nb")).alias("rows")).first())
        if work["pairs"] <= PAIRS_PER_ROW * work["rows"] or parts >= FINEST:
            if compared is not None:
                compared.append(work["pairs"])
            break
        fine = _boxes(here.withColumnRenamed("ix", "px").withColumnRenamed("iy", "py"), side, parts * 4).select(
            "rep", "px", "py", "ix", "iy").distinct()
        parts *= 4
        split = (unsure.select("a", F.col("a_ix").alias("_ax"), F.col("a_iy").alias("_ay"), "b", F.col("b_ix").alias("_bx"),
                               F.col("b_iy").alias("_by"), "dx", "dy", "la", "lb")
                 .join(fine.toDF("a", "_ax", "_ay", "a_ix", "a_iy"), ["a", "_ax", "_ay"])
                 .join(fine.toDF("b", "_bx", "_by", "b_ix", "b_iy"), ["b", "_bx", "_by"]))
        pairs = cut_lineage(_box_pairs(split, side, parts, eps).select(
            "a", "a_ix", "a_iy", "b", "b_ix", "b_iy", "dx", "dy", "sure", "la", "lb"))
        sure = cut_lineage(pairs.where("sure").select(F.col("la").alias("src"), F.col("lb").alias("dst")).distinct())
        if not sure.isEmpty():
            comp = _relabel(comp, sure)
        pairs = pairs.drop("la", "lb")
    a = here.select(F.col("rep").alias("a"), F.col("ix").alias("a_ix"), F.col("iy").alias("a_iy"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = here.select(F.col("rep").alias("b"), F.col("ix").alias("b_ix"), F.col("iy").alias("b_iy"), F.col("x").alias("bx"), F.col("y").alias("by"))
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    found = cut_lineage(unsure.join(a, ["a", "a_ix", "a_iy"]).join(b, ["b", "b_ix", "b_iy"])
                        .where(dx * dx + dy * dy <= F.lit(eps * eps))
                        .select(F.col("la").alias("src"), F.col("lb").alias("dst")).distinct())
    return comp if found.isEmpty() else _relabel(comp, found)


def detect_units(pings: DataFrame, eps: float = 20.0, min_points: int = 2,
                 keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Cluster pings; returns (units, labelled).

    ``pings`` needs ping_id (unique BIGINT), lon, lat, ts, session_hash and the
    ``keys`` columns.  ``units``: keys, cluster_id, lon, lat, report_count,
    session_count, last_ts, label.  ``labelled``: the input pings with
    ``label`` (NULL = noise) and ``cluster_id``.
    """
    keys = list(keys or ["route_id"])
    side = eps / math.sqrt(2.0)

    pings = with_xy(pings)
    positions = (pings.groupBy(*keys, "lon", "lat")
                 .agg(F.min("ping_id").alias("rep"), F.count(F.lit(1)).alias("w"),
                      F.min("x").alias("x"), F.min("y").alias("y")))
    positions = (positions.withColumn("cx", F.floor(F.col("x") / side))
                 .withColumn("cy", F.floor(F.col("y") / side)))

    cell_w = positions.groupBy(*keys, "cx", "cy").agg(F.sum("w").alias("n"))
    positions = positions.join(cell_w, keys + ["cx", "cy"])

    # 2. core flags: dense cells are all core; sparse positions count neighbours.
    dense = positions.where(F.col("n") >= min_points)
    sparse = positions.where(F.col("n") < min_points)
    near = (_neighbour_pairs(sparse, positions, keys, ALL_OFFSETS, eps)
            .groupBy(*keys, "l_rep").agg(F.sum("r_w").alias("near_w"))
            .withColumnRenamed("l_rep", "rep"))
    sparse = (sparse.join(near, keys + ["rep"], "left")
              .withColumn("core", F.col("n") + F.coalesce(F.col("near_w"), F.lit(0)) >= min_points)
              .drop("near_w"))
    # positions are far fewer than pings and feed every later step: materialise once
    flagged = cut_lineage(dense.withColumn("core", F.lit(True)).unionByName(sparse))
    core = flagged.where("core")

    # 3. cells with core positions are graph nodes; node id = min core rep of the cell.
    cell_rep = core.groupBy(*keys, "cx", "cy").agg(F.min("rep").alias("cell_rep"))
    core = core.join(cell_rep, keys + ["cx", "cy"])
    core = cut_lineage(core)
    comp = cell_components(core, keys, side, eps)
    cell_label = (cell_rep.join(comp.withColumnRenamed("node", "cell_rep"), "cell_rep", "left")
                  .select(*keys, "cx", "cy", F.coalesce("label", "cell_rep").alias("label")))
    core_lab = core.join(cell_label, keys + ["cx", "cy"]).select(*keys, "lon", "lat", "x", "y", "cx", "cy", "label")

    # 4. border positions take the smallest label among core positions within eps.
    non_core = flagged.where(~F.col("core"))
    border = (_neighbour_pairs(non_core, core_lab.withColumn("rep", F.col("label")).withColumn("w", F.lit(1)),
                               keys, ALL_OFFSETS + [(0, 0)], eps)
              .groupBy(*keys, "l_rep").agg(F.min("r_rep").alias("label"))
              .withColumnRenamed("l_rep", "rep"))
    border_lab = non_core.join(border, keys + ["rep"]).select(*keys, "lon", "lat", "label")
    pos_label = core_lab.select(*keys, "lon", "lat", "label").unionByName(border_lab)

    pos_label = cut_lineage(pos_label)
    labelled = pings.join(pos_label, keys + ["lon", "lat"], "left")  # x, y come with the pings
    rank = Window.partitionBy(*keys).orderBy("label")
    members = labelled.where(F.col("label").isNotNull())
    units = (members.groupBy(*keys, "label")
             .agg(F.count(F.lit(1)).alias("report_count"),
                  F.countDistinct("session_hash").alias("session_count"),
                  F.max("ts").alias("last_ts"),
                  F.avg("x").alias("cx_m"), F.avg("y").alias("cy_m")))
    units = geo.add_lonlat(units, "cx_m", "cy_m", "lon", "lat")
    units = units.select(
        *keys,
        (F.dense_rank().over(rank) - 1).cast(T.IntegerType()).alias("cluster_id"),
        "lon", "lat",
        "report_count", "session_count", "last_ts", "label")
    ids = units.select(*keys, "label", "cluster_id")
    labelled = labelled.join(ids, keys + ["label"], "left")
    return units, labelled
