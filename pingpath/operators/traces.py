"""Route lines built from ordered stops (A5, W4, W5, A7, A8, IO13, IO14).

Stops are a dimension (tens to thousands per route); these are small jobs that
feed broadcast sides of the ping-sized jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pingpath.config import GEOJSON_DIGITS
from pingpath.functions import geo


def build_traces(stops: DataFrame) -> DataFrame:
    """(route_id, trace ARRAY<STRUCT<lon, lat>>, n_stops); NULL trace below 2 stops."""
    agg = stops.groupBy("route_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "stop_id", "lon", "lat"))).alias("pts"),
        F.count(F.lit(1)).alias("n_stops"))
    line = F.transform("pts", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))
    return agg.select("route_id", F.when(F.col("n_stops") >= 2, line).alias("trace"), "n_stops")


def segments(stops: DataFrame) -> DataFrame:
    """Consecutive stop pairs per route (W5), with UTM end points."""
    w = Window.partitionBy("route_id").orderBy("seq", "stop_id")
    p = geo.add_utm(stops.select("route_id", "seq", "stop_id", "lon", "lat"), "lon", "lat", "x", "y")
    s = p.select(
        "route_id", F.row_number().over(w).alias("seg_idx"),
        F.col("lon").alias("a_lon"), F.col("lat").alias("a_lat"),
        F.col("x").alias("ax"), F.col("y").alias("ay"),
        F.lead("lon").over(w).alias("b_lon"), F.lead("lat").over(w).alias("b_lat"),
        F.lead("x").over(w).alias("bx"), F.lead("y").over(w).alias("by"))
    return s.where(F.col("b_lon").isNotNull())


def trace_length(stops: DataFrame) -> DataFrame:
    """(route_id, length_km) of the line through the stops."""
    s = segments(stops)
    d = geo.geodesic_m(F.col("ax"), F.col("ay"), F.col("a_lat"), F.col("bx"), F.col("by"), F.col("b_lat"))
    return s.groupBy("route_id").agg((F.sum(d) / 1000.0).alias("length_km"))


def stop_flags(stops: DataFrame) -> DataFrame:
    """Stops with is_first / is_last flags along the route."""
    asc = Window.partitionBy("route_id").orderBy("seq", "stop_id")
    desc = Window.partitionBy("route_id").orderBy(F.col("seq").desc(), F.col("stop_id").desc())
    return stops.select("*", (F.row_number().over(asc) == 1).alias("is_first"),
                        (F.row_number().over(desc) == 1).alias("is_last"))


def trace_geojson(traces: DataFrame) -> DataFrame:
    """GeoJSON LineString text per route, NULL without a trace (IO13)."""
    return traces.select("route_id", F.to_json(geojson_line(F.col("trace"))).alias("geojson"))


def geojson_line(trace):
    """LineString struct of a trace, coordinates with at most 9 decimals; NULL without a trace."""
    coords = F.transform(trace, lambda p: F.array(F.round(p["lon"], GEOJSON_DIGITS), F.round(p["lat"], GEOJSON_DIGITS)))
    return F.when(trace.isNotNull(), F.struct(F.lit("LineString").alias("type"), coords.alias("coordinates")))


def _wkt_point(lon, lat):
    return F.format_string("POINT(%s %s)", lon, lat)


def endpoints_wkt(traces: DataFrame) -> DataFrame:
    """WKT of the first and last point of each trace (IO14)."""
    first = F.element_at("trace", 1)
    last = F.element_at("trace", -1)
    return traces.where(F.col("trace").isNotNull()).select(
        "route_id",
        _wkt_point(first["lon"].cast("string"), first["lat"].cast("string")).alias("start_wkt"),
        _wkt_point(last["lon"].cast("string"), last["lat"].cast("string")).alias("end_wkt"))


def stops_per_route(stops: DataFrame, routes: DataFrame) -> DataFrame:
    """Stop count with first and last stop name per route."""
    w = stops.groupBy("route_id").agg(
        F.count(F.lit(1)).alias("n_stops"),
        F.min_by("name", F.struct("seq", "stop_id")).alias("first_stop"),
        F.max_by("name", F.struct("seq", "stop_id")).alias("last_stop"))
    return routes.select("route_id", "code").join(w, "route_id", "left").select(
        "route_id", "code", F.coalesce("n_stops", F.lit(0)).alias("n_stops"), "first_stop", "last_stop")
