"""Nearest stops per vehicle with distance and ETA.

Stops are counted in square cells per route at several levels, each level's cells
twice as wide as those below.  A point looks up the lowest level at which the nine
cells around it hold ``k`` stops: its ``k`` nearest then lie within 2 sqrt(2) cell
sides, so the nine cells around it two levels higher hold them for certain, and one
join on those cells finds them.  A point in a dense place starts with small cells, a
lone one with large cells; work per point follows the stops near it, not those of its
route, and the only written table is that of the points.  Ranking follows the
original service: planar distance in degrees (``metric="degrees"``), ties by stop
order; ``metric="metres"`` ranks by ellipsoidal metres instead, with as many levels
more as the parallels shrink.  Reported distances are always metres.

Defined cases: points on a route without stops, and points without coordinates, have
no nearest stops and give no row; stops without coordinates are nobody's; a route of
fewer than ``k`` stops gives them all; points repeated each give their rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pingpath.config import DEFAULT_SPEED_M_PER_MIN, SPEEDS_M_PER_MIN
from pingpath.functions import geo
from pingpath.session import materialise


def speed_of(kind_col, speeds: dict | None = None, default: float = DEFAULT_SPEED_M_PER_MIN):
    speeds = SPEEDS_M_PER_MIN if speeds is None else speeds
    expr = None
    for kind, v in speeds.items():
        expr = (F.when(kind_col == kind, F.lit(float(v))) if expr is None
                else expr.when(kind_col == kind, F.lit(float(v))))
    return F.lit(float(default)) if expr is None else expr.otherwise(F.lit(float(default)))


#: How far the k stops in the nine cells around a point can be, in cell sides.
_REACH = 2 * math.sqrt(2)
#: Metres a degree spans: at most anywhere, and at least along a meridian or (times the cosine) a parallel.
_DEGREE_MOST, _DEGREE_LEAST = 111_700.0, 110_000.0


def ladder(points: DataFrame, stops: DataFrame) -> tuple[float, int]:
    """(side of the lowest cells, top level): a quarter of the median hop between stops, up to cells that span all."""
    w = Window.partitionBy("route_id").orderBy("seq", "stop_id")
    hop = geo.degree_distance(F.col("lon"), F.col("lat"), F.lead("lon").over(w), F.lead("lat").over(w))
    places = stops.select("lon", "lat", hop.alias("hop")).unionByName(
        points.select("lon", "lat", F.lit(None).cast("double").alias("hop")))
    r = places.agg(F.percentile_approx("hop", 0.5), F.max("lon") - F.min("lon"), F.max("lat") - F.min("lat")).first()
    extent = max(r[1] or 0.0, r[2] or 0.0)
    side = max((r[0] or 0.0) / 4, extent / 2 ** 20, 1e-6)
    return side, max(math.ceil(math.log2(max(extent, side) / side)), 0) + 1


def _cell(c: str, side: float, level) -> F.Column:
    return F.floor(F.col(c) / (F.lit(side) * F.pow(F.lit(2.0), level)))


def _around(df: DataFrame, x, y) -> DataFrame:
    """Each row once for each of the nine cells around (x, y), as ``_gx`` and ``_gy``."""
    nine = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    return df.select("*", nine.alias("_o")).select("*", (x + F.col("_o.i")).alias("_gx"), (y + F.col("_o.j")).alias("_gy")).drop("_o")


def _levels_up(metric: str):
    """Levels from the one with k stops around to the one whose neighbouring cells hold the k nearest."""
    if metric == "metres":
        shrink = F.greatest(F.cos(F.radians(F.least(F.abs("lat") + 1.0, F.lit(90.0)))), F.lit(1e-6))
        return F.ceil(F.log2(F.lit(_REACH * _DEGREE_MOST / _DEGREE_LEAST) / shrink)).cast("int")
    return F.lit(math.ceil(math.log2(_REACH)))


def start_levels(points: DataFrame, cells: DataFrame, side: float, top: int, k: int) -> DataFrame:
    """(_row, _start): the lowest level at which the nine cells around a point hold k stops; none if no level does.

    ``cells`` has one row for each stop and level.  Full neighbourhoods are summed on the
    side of the stops, so a point meets at most one row a level.
    """
    counts = cells.groupBy("route_id", "_level", "_gx", "_gy").agg(F.count(F.lit(1)).alias("n"))
    full = (_around(counts.withColumnRenamed("_gx", "_x").withColumnRenamed("_gy", "_y"), F.col("_x"), F.col("_y"))
            .groupBy("route_id", "_level", "_gx", "_gy").agg(F.sum("n").alias("n")).where(F.col("n") >= k).drop("n"))
    tries = points.select("_row", "route_id", "lon", "lat", F.explode(F.sequence(F.lit(0), F.lit(top))).alias("_level"))
    tries = tries.withColumn("_gx", _cell("lon", side, F.col("_level"))).withColumn("_gy", _cell("lat", side, F.col("_level")))
    return tries.join(full, ["route_id", "_level", "_gx", "_gy"]).groupBy("_row").agg(F.min("_level").alias("_start"))


def nearest_stops(points: DataFrame, stops: DataFrame, k: int = 3, metric: str = "degrees") -> DataFrame:
    """For each row of ``points`` (route_id, lon, lat, ...) its ``k`` nearest stops.

    Adds stop_rank (1..k), stop_id, stop_name, stop_seq, stop_lon, stop_lat,
    distance_raw_m.  Points on a route without stops disappear (inner join).
    """
    located = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    at = materialise(points.where(located).withColumn("_row", F.monotonically_increasing_id()), "nearest-points")
    stops = stops.where(located)
    side, top = ladder(at, stops)
    level = F.col("_level")
    cells = (stops.select("route_id", F.col("seq").alias("stop_seq"), "stop_id", F.col("name").alias("stop_name"),
                          F.col("lon").alias("stop_lon"), F.col("lat").alias("stop_lat"),
                          F.explode(F.sequence(F.lit(0), F.lit(top))).alias("_level"))
             .withColumn("_gx", _cell("stop_lon", side, level)).withColumn("_gy", _cell("stop_lat", side, level)))
    begun = at.join(start_levels(at, cells, side, top, k), "_row", "left")
    begun = begun.withColumn("_level", F.least(F.coalesce(F.col("_start") + _levels_up(metric), F.lit(top)), F.lit(top)))
    near = _around(begun, _cell("lon", side, level), _cell("lat", side, level))
    pairs = near.join(cells, ["route_id", "_level", "_gx", "_gy"])
    if metric == "metres":
        ux, uy = geo.to_utm(F.col("lon"), F.col("lat"))
        sx, sy = geo.to_utm(F.col("stop_lon"), F.col("stop_lat"))
        d = geo.geodesic_m(ux, uy, F.col("lat"), sx, sy, F.col("stop_lat"))
    else:
        d = geo.degree_distance(F.col("lon"), F.col("lat"), F.col("stop_lon"), F.col("stop_lat"))
    order = Window.partitionBy("_row").orderBy("_d", "stop_seq", "stop_id")
    ranked = (pairs.withColumn("_d", d).withColumn("stop_rank", F.row_number().over(order).cast("int"))
              .where(F.col("stop_rank") <= k))
    a = geo.add_utm(geo.add_utm(ranked, "lon", "lat", "_ux", "_uy"), "stop_lon", "stop_lat", "_sx", "_sy")
    distance = geo.geodesic_m(F.col("_ux"), F.col("_uy"), F.col("lat"), F.col("_sx"), F.col("_sy"), F.col("stop_lat"))
    return a.select(*points.columns, "stop_rank", "stop_id", "stop_name", "stop_seq", "stop_lon", "stop_lat",
                    distance.alias("distance_raw_m"))


def nearest_of_point(stops: DataFrame, lon0: float, lat0: float, k: int = 5) -> DataFrame:
    """The k stops nearest to one point, whatever their route: order and limit."""
    d = geo.degree_distance(F.lit(lon0), F.lit(lat0), F.col("lon"), F.col("lat"))
    return stops.withColumn("distance_deg", d).orderBy("distance_deg", "seq", "stop_id").limit(k)


def with_eta(df: DataFrame, speed, digits_distance: int = 1, digits_eta: int = 1) -> DataFrame:
    """distance_m and eta_minutes, each rounded half-up from the raw distance."""
    return (df.withColumn("distance_m", geo.round_half_up(F.col("distance_raw_m"), digits_distance))
            .withColumn("eta_minutes", geo.round_half_up(F.col("distance_raw_m") / speed, digits_eta)))
