"""User-level jobs: what the service answers, for all routes in one plan.

Each function takes DataFrames (routes, stops, pings...) plus an explicit
``as_of`` instant and returns DataFrames; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pingpath.config import Params
from pingpath.operators import cluster, live, nearest, stats
from pingpath.operators import traces as tr


def active_routes(routes: DataFrame) -> DataFrame:
    return routes.where(F.col("active"))


def live_on_active_routes(pings: DataFrame, routes: DataFrame, as_of, params: Params) -> DataFrame:
    lp = live.live_pings(pings, as_of, params.live_window_s)
    return lp.join(active_routes(routes).select("route_id"), "route_id", "left_semi")


def units(pings: DataFrame, routes: DataFrame, as_of, params: Params = Params()) -> DataFrame:
    """Detected vehicles on every active route (A3/A4): one clustering job."""
    lp = live_on_active_routes(pings, routes, as_of, params)
    u, _ = cluster.detect_units(lp, params.eps_m, params.min_points, ["route_id"])
    return u


def noise(pings: DataFrame, routes: DataFrame, as_of, params: Params = Params()) -> DataFrame:
    """Live pings that belong to no vehicle."""
    lp = live_on_active_routes(pings, routes, as_of, params)
    _, labelled = cluster.detect_units(lp, params.eps_m, params.min_points, ["route_id"])
    return labelled.where(F.col("label").isNull()).drop("label", "cluster_id")


def route_status(pings: DataFrame, routes: DataFrame, stops: DataFrame, as_of,
                 params: Params = Params(), metric: str = "degrees") -> DataFrame:
    """Vehicles with their nearest stops and ETA for all active routes.

    Columns: code, cluster_id, lat, lon, report_count, last_ts, stop_name,
    distance_m, eta_minutes (+ route_id, stop_rank, session_count).
    """
    u = units(pings, routes, as_of, params)
    ranked = nearest.nearest_stops(u, stops, params.nearest_k, metric)
    meta = active_routes(routes).select("route_id", "code", "kind")
    ranked = ranked.join(meta, "route_id")
    speed = nearest.speed_of(F.col("kind"), params.speeds, params.default_speed)
    out = nearest.with_eta(ranked, speed)
    return out.select("route_id", "code", "cluster_id", "lat", "lon", "report_count",
                      "session_count", "last_ts", "stop_rank", "stop_name", "distance_m",
                      "eta_minutes")


def _answer_order():
    return [F.col("last_ts").desc(), F.col("distance_m"), F.col("cluster_id"), F.col("stop_rank")]


def route_status_ordered(status: DataFrame) -> DataFrame:
    """The status rows in the service's order; ``position`` numbers them within a route."""
    w = Window.partitionBy("route_id").orderBy(*_answer_order())
    return status.withColumn("position", F.row_number().over(w)).orderBy(*_answer_order())


def route_answers(status: DataFrame, routes: DataFrame, max_stops: int | None = None) -> DataFrame:
    """One nested answer per active route (C2, A9): code, total, answer (JSON text).

    Units come in the order of their first row, each with its stops by distance
    (the first ``max_stops`` of them, T3); a route without units answers total 0.
    Units of a route are those of the live window.
    """
    # Field names of the service's answer.
    stop = F.struct(F.col("stop_name").alias("nombre"), F.col("distance_m").alias("distancia_m"),
                    F.col("eta_minutes").alias("eta_minutos"))
    by_unit = status.groupBy("route_id", "cluster_id").agg(
        F.first("lat").alias("lat"), F.first("lon").alias("lon"), F.first("report_count").alias("n"),
        F.max("last_ts").alias("last_ts"), F.min("distance_m").alias("near"),
        F.array_sort(F.collect_list(F.struct(F.col("distance_m").alias("d"), F.col("stop_rank").alias("r"), stop.alias("s")))).alias("stops"))
    stops = F.col("stops.s") if max_stops is None else F.slice(F.col("stops.s"), 1, max_stops)
    unit = F.struct(F.col("cluster_id").alias("unidad_id"), F.struct("lat", "lon").alias("posicion"),
                    F.col("n").alias("confianza"),
                    F.date_format("last_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ultima_actualizacion"),
                    stops.alias("proximas_paradas"))
    newest = -F.unix_micros(F.col("last_ts").cast("timestamp"))
    nested = by_unit.groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct(
        newest.alias("t"), F.col("near"), F.col("cluster_id").alias("c"), unit.alias("u")))).alias("units"))
    j = active_routes(routes).select("route_id", "code").join(nested, "route_id", "left")
    total = F.coalesce(F.size("units"), F.lit(0))
    answer = F.to_json(F.struct(F.col("code").alias("ruta"),
                                F.when(F.col("units").isNotNull(), F.col("units.u")).otherwise(F.array()).alias("unidades"),
                                F.greatest(total, F.lit(0)).alias("total")), {"ignoreNullFields": "false"})
    return j.select("code", F.greatest(total, F.lit(0)).alias("total"), answer.alias("answer"))


def answer_for(answers: DataFrame, code: str) -> str:
    """The answer of one route; an unknown or inactive code is an error, as it is for the service."""
    row = answers.where(F.col("code") == code).select("answer").first()
    if row is None:
        raise LookupError(f"route {code!r} not found")
    return row["answer"]


def route_payloads(routes: DataFrame, stops: DataFrame) -> DataFrame:
    """One payload per active route: line and ordered stops (C4): code, payload (JSON text)."""
    # Field names of the service's answer.
    item = F.struct(F.col("name").alias("nombre"), F.col("seq").alias("orden"), "lat", "lon")
    st = stops.groupBy("route_id").agg(F.array_sort(F.collect_list(
        F.struct(F.col("seq").alias("o"), F.col("stop_id").alias("i"), item.alias("s")))).alias("stops"))
    j = (active_routes(routes).select("route_id", "code", "name", "kind")
         .join(tr.build_traces(stops).select("route_id", "trace"), "route_id", "left").join(st, "route_id", "left"))
    payload = F.to_json(F.struct(F.col("code").alias("clave"), F.col("name").alias("nombre"), F.col("kind").alias("tipo"),
                                 tr.geojson_line(F.col("trace")).alias("trazado"),
                                 F.when(F.col("stops").isNotNull(), F.col("stops.s")).otherwise(F.array()).alias("paradas")),
                        {"ignoreNullFields": "false"})
    return j.select("code", payload.alias("payload"))


def system_stats(pings: DataFrame, routes: DataFrame, as_of, params: Params = Params()):
    """(per-route stats, live total, dashboard totals) for the statistics screen."""
    lp = live.live_pings(pings, as_of, params.live_window_s)
    u = units(pings, routes, as_of, params)
    per_route = stats.route_stats(lp, routes, u)
    return per_route, stats.live_total(lp, params.live_window_s // 60), stats.dashboard(per_route)


def route_trace(routes: DataFrame, stops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(active routes with GeoJSON line, their stops in order with first/last flags) (C4)."""
    act = active_routes(routes).select("route_id", "code", "name", "kind")
    lines = act.join(tr.trace_geojson(tr.build_traces(stops)), "route_id", "left")
    st = tr.stop_flags(stops.join(act.select("route_id", "code"), "route_id"))
    return lines, st


def nearest_from_point(stops: DataFrame, routes: DataFrame, lon0: float, lat0: float, k: int = 5,
                       speed: float = 583.0, params: Params = Params()) -> DataFrame:
    """The k nearest stops of every active route to one point, with ETA."""
    pts = active_routes(routes).select("route_id", "code", F.lit(float(lon0)).alias("lon"),
                                       F.lit(float(lat0)).alias("lat"))
    ranked = nearest.nearest_stops(pts, stops, k, "degrees")
    return nearest.with_eta(ranked, F.lit(float(speed)))


def unit_nearest_stops(pings: DataFrame, routes: DataFrame, stops: DataFrame, as_of,
                       params: Params = Params(), k: int = 2, speed: float = 583.0) -> DataFrame:
    """Each vehicle with its k nearest stops, metres rounded to 0 decimals."""
    u = units(pings, routes, as_of, params)
    ranked = nearest.nearest_stops(u, stops, k, "degrees")
    return nearest.with_eta(ranked, F.lit(float(speed)), digits_distance=0)
