"""Registered queries over the benchmark tables, each with its SQL oracle.

Every query reads the benchmark tables of ``sf_dir`` through the driver-data
adapter (routes, stops and ping attempts derived from region, nation, supplier
and events), runs the library on all of it and returns a flat DataFrame whose
column names equal the oracle's.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pingpath.functions import geo
from pingpath.operators import cluster, dims, live, nearest, quality, sessions, stats
from pingpath.operators import ingest as ing
from pingpath.operators import traces as tr
from pingpath.plans import oracle as O
from pingpath.plans import service
from pingpath.session import ensure_checkpoint_dir, materialise
from pingpath.sources import driver
from pingpath.sources.tables import PING_COLUMNS, STORE, read_pings, read_stops, write_pings, write_stops
from pingpath.streaming import live_stream as stream
from pingpath.streaming import unit_refresh

P = driver.DRIVER_PARAMS


@dataclass
class Dims:
    routes: DataFrame
    stops: DataFrame
    as_of: object


@dataclass
class Facts(Dims):
    pings: DataFrame
    rejected: DataFrame
    store: str


_MEMO: dict = {}


def _once(kind: str, spark: SparkSession, sf_dir: str, make):
    key = (kind, id(spark), spark.sparkContext.applicationId, sf_dir)
    if key not in _MEMO:
        _MEMO[key] = make()
    return _MEMO[key]


def dimensions(spark: SparkSession, sf_dir: str) -> Dims:
    """Routes and stops, derived once; queries on them run no ingest."""
    return _once("dims", spark, sf_dir, lambda: Dims(
        materialise(driver.routes(spark, sf_dir), "routes"), materialise(driver.stops(spark, sf_dir), "stops"),
        driver.as_of(spark, sf_dir)))


def inputs(spark: SparkSession, sf_dir: str) -> Facts:
    """One ingest run into the month-partitioned store and the quarantine, shared by the queries of a session."""
    def make() -> Facts:
        d = dimensions(spark, sf_dir)
        accepted, rejected = ing.ingest(driver.raw_pings(spark, sf_dir, d.stops), d.routes, d.stops, P)
        store = new_folder(spark, "pings")
        write_pings(accepted, store)
        return Facts(d.routes, d.stops, d.as_of, read_pings(spark, store), materialise(rejected, "quarantine"), store)
    return _once("facts", spark, sf_dir, make)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def r6(c):
    return geo.round_half_up(c, 6)


# ---------------------------------------------------------------- Spark side

def q_route_status(spark, sf_dir):
    i = inputs(spark, sf_dir)
    st = service.route_status(i.pings, i.routes, i.stops, i.as_of, P)
    return st.select("code", "cluster_id", r6(F.col("lat")).alias("lat"), r6(F.col("lon")).alias("lon"),
                     "report_count", "session_count", "last_ts", "stop_rank", "stop_name",
                     "distance_m", "eta_minutes")


def q_units(spark, sf_dir):
    i = inputs(spark, sf_dir)
    u = service.units(i.pings, i.routes, i.as_of, P)
    return u.select("route_id", "cluster_id", r6(F.col("lon")).alias("lon"), r6(F.col("lat")).alias("lat"),
                    "report_count", "session_count", "last_ts")


def q_noise(spark, sf_dir):
    i = inputs(spark, sf_dir)
    return service.noise(i.pings, i.routes, i.as_of, P).select(
        "ping_id", "session_hash", "route_id", "lon", "lat", "ts")


def q_ingested(spark, sf_dir):
    return inputs(spark, sf_dir).pings.select(*PING_COLUMNS)


def q_quarantine(spark, sf_dir):
    return inputs(spark, sf_dir).rejected


def q_live_age(spark, sf_dir):
    i = inputs(spark, sf_dir)
    lp = live.live_pings(i.pings, i.as_of, P.live_window_s)
    return live.with_age(lp, i.routes, i.as_of)


POINT = (-103.43, 20.6)  # query point for C7 / PF10 on the derived data
RADIUS_M = 500.0
TERM = "ri"
PATTERN = "a_%"
RENAME = ("R1", "Ruta R1 corregida")


def q_route_stats(spark, sf_dir):
    i = inputs(spark, sf_dir)
    per_route, _, _ = service.system_stats(i.pings, i.routes, i.as_of, P)
    return per_route.select("code", "kind", "live_pings", "units")


def q_live_total(spark, sf_dir):
    i = inputs(spark, sf_dir)
    return stats.live_total(live.live_pings(i.pings, i.as_of, P.live_window_s), P.live_window_s // 60)


def q_route_status_ordered(spark, sf_dir):
    i = inputs(spark, sf_dir)
    st = service.route_status(i.pings, i.routes, i.stops, i.as_of, P)
    return service.route_status_ordered(st).select("code", "position", "cluster_id", "last_ts", "stop_name", "distance_m")


def _answer_rows(spark, sf_dir):
    i = inputs(spark, sf_dir)
    st = service.route_status(i.pings, i.routes, i.stops, i.as_of, P)
    return st.withColumn("lat", r6(F.col("lat"))).withColumn("lon", r6(F.col("lon"))), i.routes


def q_route_answer(spark, sf_dir):
    return service.route_answers(*_answer_rows(spark, sf_dir))


def q_route_answer_first_stop(spark, sf_dir):
    return service.route_answers(*_answer_rows(spark, sf_dir), max_stops=1)


def q_route_payload(spark, sf_dir):
    d = dimensions(spark, sf_dir)
    return service.route_payloads(d.routes, d.stops)


def q_nearest_k_of_point(spark, sf_dir):
    d = dimensions(spark, sf_dir)
    return nearest.nearest_of_point(d.stops, *POINT, 7).select("stop_id", "route_id", "name", r6(F.col("distance_deg")).alias("distance_deg"))


def q_purge_kept(spark, sf_dir):
    """What a purge to one day leaves in a copy of the store."""
    i = inputs(spark, sf_dir)
    store = new_folder(spark, "purged")
    write_pings(i.pings.drop("month"), store)
    live.purge_store(spark, store, i.as_of, 24)
    return read_pings(spark, store).select(*PING_COLUMNS)


def q_stream_ingested(spark, sf_dir):
    """The events as a stream of eight files, dealt by hash so that every trigger has late rows: the newest decision of every attempt."""
    d = dimensions(spark, sf_dir)
    root = new_folder(spark, "stream")
    events = driver._table(spark, sf_dir, "events")
    body = stream.ingest_body(spark, root, d.routes, d.stops, P)
    files = f"{root}/events"
    # several row groups a file, so that more tasks than files share a trigger
    events.repartition(8, "event_id").write.option("parquet.block.size", str(8 << 20)).parquet(files)
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(files)
    _drain(source, lambda batch, n: body(driver.attempts_from_events(batch, d.stops), n), f"{root}/progress", "append")
    return stream.current(spark, root).select("ping_id", "session_hash", "code", "lon", "lat", "ts", "reject_reason")


def q_stream_counts(spark, sf_dir):
    """Sliding two-minute counts of the stored pings as a stream, newest count of each window."""
    i = inputs(spark, sf_dir)
    root = new_folder(spark, "counts")
    counts = stream.live_counts(spark.readStream.schema(STORE).parquet(i.store))
    _drain(counts, stream.counts_body(spark, root), f"{root}/progress", "update")
    return stream.current_counts(spark, root).select(
        F.unix_seconds("window_start").alias("window_start_s"), "route_id", "pings")


def q_stream_units(spark, sf_dir):
    """The stored pings as a stream of four triggers, the last three of four hours each: the units after the last of them."""
    i = inputs(spark, sf_dir)
    root = new_folder(spark, "live-units")
    body = unit_refresh.refresh_changed_units(spark, f"{root}/state", i.routes, P)
    newest = i.pings.agg(F.max("ts")).first()[0]
    age = F.timestamp_diff("SECOND", F.col("ts"), F.lit(newest)) if newest else F.lit(0)
    pings = i.pings.select(*STORE.fieldNames())
    for k in range(4):  # slice 0 is all that is older than twelve hours
        part = pings.where(F.greatest(F.lit(0), 3 - F.floor(age / 14_400)) == k)
        part.write.mode("append").parquet(f"{root}/pings")
        _drain(spark.readStream.schema(STORE).parquet(f"{root}/pings"), body, f"{root}/progress", "append")
    return unit_refresh.live_units(spark, f"{root}/state").select(
        "route_id", "cluster_id", r6(F.col("lon")).alias("lon"), r6(F.col("lat")).alias("lat"), "report_count", "session_count", "last_ts")


def _drain(df, body, progress: str, mode: str) -> None:
    q = (df.writeStream.outputMode(mode).foreachBatch(body).option("checkpointLocation", progress)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def q_dashboard(spark, sf_dir):
    i = inputs(spark, sf_dir)
    return service.system_stats(i.pings, i.routes, i.as_of, P)[2]


def q_active_routes(spark, sf_dir):
    return stats.active_routes_list(dimensions(spark, sf_dir).routes)


def q_routes_by_kind(spark, sf_dir):
    return stats.routes_by_kind(dimensions(spark, sf_dir).routes)


def q_route_search(spark, sf_dir):
    return stats.search_routes(dimensions(spark, sf_dir).routes, TERM).select("code", "name", "kind", "active")


def q_route_trace_stops(spark, sf_dir):
    i = dimensions(spark, sf_dir)
    _, st = service.route_trace(i.routes, i.stops)
    return st.select("code", F.col("name").alias("stop_name"), "seq", "lat", "lon", "is_first", "is_last")


def q_route_geojson(spark, sf_dir):
    i = dimensions(spark, sf_dir)
    lines, _ = service.route_trace(i.routes, i.stops)
    return lines.select("code", "name", "kind", "geojson")


def q_trace_endpoints(spark, sf_dir):
    i = dimensions(spark, sf_dir)
    e = tr.endpoints_wkt(tr.build_traces(i.stops))
    return e.join(i.routes.select("route_id", "code"), "route_id").select("code", "start_wkt", "end_wkt")


def q_trace_length(spark, sf_dir):
    i = dimensions(spark, sf_dir)
    t = tr.trace_length(i.stops).join(i.routes.select("route_id", "code"), "route_id")
    return t.select("code", geo.round_half_up(F.col("length_km"), 3).alias("length_km"))


def q_stops_per_route(spark, sf_dir):
    i = dimensions(spark, sf_dir)
    return tr.stops_per_route(i.stops, i.routes).select("code", "n_stops", "first_stop", "last_stop")


def q_nearest_from_point(spark, sf_dir):
    i = dimensions(spark, sf_dir)
    n = service.nearest_from_point(i.stops, i.routes, POINT[0], POINT[1], 5, 583.0, P)
    return n.select("code", "stop_rank", "stop_name", "distance_m", "eta_minutes")


def q_unit_nearest_stops(spark, sf_dir):
    i = inputs(spark, sf_dir)
    n = service.unit_nearest_stops(i.pings, i.routes, i.stops, i.as_of, P, 2, 583.0)
    return n.select("route_id", "cluster_id", "report_count", "stop_rank", "stop_name",
                    F.col("distance_m").alias("dist_m"), F.col("eta_minutes").alias("eta_min"))


def q_within_radius(spark, sf_dir):
    i = inputs(spark, sf_dir)
    r = live.within_radius(i.pings, POINT[0], POINT[1], RADIUS_M)
    return r.select("ping_id", "route_id", geo.round_half_up(F.col("distance_m"), 1).alias("distance_m"))


def q_purge_report(spark, sf_dir):
    i = inputs(spark, sf_dir)
    return live.purge_report(i.pings, i.as_of, 24)


def q_sessions_like(spark, sf_dir):
    i = inputs(spark, sf_dir)
    return live.delete_sessions_like(i.pings, PATTERN).select("ping_id", "session_hash")


def q_sessions_deleted(spark, sf_dir):
    """What a delete by pattern leaves in a copy of the store."""
    i = inputs(spark, sf_dir)
    store = new_folder(spark, "deleted")
    write_pings(i.pings.drop("month"), store)
    live.delete_stored_sessions_like(spark, store, PATTERN)
    return read_pings(spark, store).select(*PING_COLUMNS)


def q_stops_overwritten(spark, sf_dir):
    """The stop store after the routes of a stop file were overwritten in it."""
    d = dimensions(spark, sf_dir)
    store = new_folder(spark, "stops")
    write_stops(d.stops, store)
    dims.reload_stored_stops(spark, store, d.routes, new_stop_file(spark, sf_dir))
    return read_stops(spark, store).select("stop_id", "route_id", "name", "seq", r6(F.col("lon")).alias("lon"), r6(F.col("lat")).alias("lat"))


def q_ingested_once(spark, sf_dir):
    """Attempts of which a third is sent a second time: each comes out once."""
    d = dimensions(spark, sf_dir)
    raw = driver.raw_pings(spark, sf_dir, d.stops)
    accepted, rejected = ing.ingest(raw.unionByName(raw.where("ping_id % 3 = 0")), d.routes, d.stops, P)
    return (accepted.select("ping_id", F.lit(None).cast("string").alias("reject_reason"))
            .unionByName(rejected.select("ping_id", "reject_reason")))


def q_quality_report(spark, sf_dir):
    """The checks on the tables with defects mixed in, so that every one of them has rows."""
    i = inputs(spark, sf_dir)
    routes = i.routes.unionByName(i.routes.where("route_id = 2").withColumn("route_id", F.lit(102))).unionByName(
        i.routes.where("route_id = 3").withColumn("code", F.lit("R2b")).withColumn("name", F.lit(None).cast("string")))
    stops = (i.stops.unionByName(i.stops.where("stop_id % 7 = 0").withColumn("route_id", F.col("route_id") + 200))
             .unionByName(i.stops.where("stop_id % 11 = 0").withColumn("stop_id", F.col("stop_id") + 1_000_000)
                          .withColumn("lon", F.lit(None).cast("double"))))
    pings = i.pings.select(*PING_COLUMNS)
    pings = (pings.unionByName(pings.where("ping_id % 50 = 1").withColumn("route_id", F.col("route_id") + 200))
             .unionByName(pings.where("ping_id % 40 = 3").withColumn("ping_id", F.col("ping_id") + 10_000_000)
                          .withColumn("session_hash", F.lit(None).cast("string")).withColumn("lat", F.lit(20.40))))
    return quality.quality_report(routes, stops, pings)


def q_unit_labels(spark, sf_dir):
    i = inputs(spark, sf_dir)
    u = service.units(i.pings, i.routes, i.as_of, P)
    return stats.unit_labels(u, i.as_of).select("route_id", "cluster_id", "confidence", "band", "age_label")


def q_route_bbox(spark, sf_dir):
    i = dimensions(spark, sf_dir)
    b = stats.route_bbox(tr.build_traces(i.stops)).join(i.routes.select("route_id", "code"), "route_id")
    return b.select("code", "south", "west", "north", "east", F.to_json("latlon").alias("latlon"))


def new_stop_file(spark, sf_dir):
    """Corrected stop lists for routes R0 and R1, by balance; one supplier in ten names no route."""
    s = driver._table(spark, sf_dir, "supplier")
    n = driver._table(spark, sf_dir, "nation").where(F.col("n_regionkey") <= 1)
    j = s.join(n, s.s_nationkey == n.n_nationkey)
    w = Window.partitionBy("n_regionkey").orderBy("s_acctbal", "s_suppkey")
    return j.select(F.col("s_suppkey").alias("stop_id"),
                    F.when(F.col("s_suppkey") % 10 == 3, F.lit("RX")).otherwise(
                        F.concat(F.lit("R"), F.col("n_regionkey").cast("string"))).alias("code"),
                    F.concat(F.lit("Nueva "), F.col("s_name")).alias("name"),
                    (F.lit(-103.45) + F.lit(0.01) * F.col("n_nationkey")).alias("lon"),
                    (F.lit(20.42) + F.col("s_acctbal") / F.lit(30000.0)).alias("lat"),
                    F.row_number().over(w).cast("int").alias("seq"))


def q_reload_stops(spark, sf_dir):
    """The reloaded routes: stops, length, rebuilt line and audit stamp."""
    i = dimensions(spark, sf_dir)
    t0 = live._instant(driver._table(spark, sf_dir, "events").agg(F.min("ts")).first()[0])
    routes = i.routes.withColumn("created_at", t0).withColumn("updated_at", t0).withColumn("trace", F.lit(None).cast(
        "array<struct<lon:double,lat:double>>"))
    new_routes, _, report, _ = dims.reload_stops(routes, i.stops, new_stop_file(spark, sf_dir), i.as_of)
    lines = tr.trace_geojson(new_routes.select("route_id", "trace")).join(new_routes.select("route_id", "updated_at"), "route_id")
    return report.join(lines, "route_id").select(
        "code", "n_stops", "first_stop", "last_stop", geo.round_half_up(F.col("length_km"), 3).alias("length_km"),
        F.md5(F.col("geojson").cast("binary")).alias("line_md5"), "updated_at")


def q_reload_unresolved(spark, sf_dir):
    """Rows of the stop file that name no route."""
    i = dimensions(spark, sf_dir)
    return dims.reload_stops(i.routes, i.stops, new_stop_file(spark, sf_dir))[3].select("stop_id", "code", "name")


def q_routes_merged(spark, sf_dir):
    i = dimensions(spark, sf_dir)
    n = driver._table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    new = n.select(F.concat(F.lit("R"), (k % 7).cast("string")).alias("code"),
                   F.col("n_name").alias("name"),
                   F.when(k % 3 == 0, "tren_ligero").when(k % 3 == 1, "autobus").otherwise("alimentador").alias("kind"),
                   F.lit(True).alias("active"), k.alias("_order"))
    merged = dims.insert_if_absent(i.routes.withColumn("_order", F.lit(-1)), new, "code", "_order")
    return merged.select("code", "name", "kind", "active")


def q_stops_after_cascade(spark, sf_dir):
    i = dimensions(spark, sf_dir)
    kept_routes = i.routes.where(F.col("active"))
    st = dims.cascade_delete(i.stops, kept_routes, "route_id")
    return st.groupBy("route_id").agg(F.count(F.lit(1)).alias("n_stops"))


def q_routes_renamed(spark, sf_dir):
    i = dimensions(spark, sf_dir)
    patch = spark.range(1).select(F.lit(RENAME[0]).alias("code"), F.lit(RENAME[1]).alias("name"))
    return dims.update_attribute(i.routes, patch, "code").select("code", "name", "kind", "active")


def q_units_history(spark, sf_dir):
    i = inputs(spark, sf_dir)
    act = i.pings.join(i.routes.where("active").select("route_id"), "route_id", "left_semi").drop("month")
    u, _ = cluster.detect_units(act.withColumn("day", F.to_date("ts")), P.eps_m, P.min_points,
                                ["route_id", "day"])
    return u.select("route_id", "day", "cluster_id", r6(F.col("lon")).alias("lon"), r6(F.col("lat")).alias("lat"),
                    "report_count", "session_count", "last_ts")


def q_audit_stamps(spark, sf_dir):
    """Routes created at the first event; R1 renamed and R2 rewritten unchanged at as_of."""
    i = dimensions(spark, sf_dir)
    t0 = driver._table(spark, sf_dir, "events").agg(F.min("ts")).first()[0]
    t0c = live._instant(t0)
    old = i.routes.withColumn("created_at", t0c).withColumn("updated_at", t0c)
    patch = spark.range(1).select(F.lit(RENAME[0]).alias("code"), F.lit(RENAME[1]).alias("name"))
    written = dims.update_attribute(i.routes, patch, "code").where(F.col("code").isin("R1", "R2"))
    stamped = dims.stamp_audit(written, old, "route_id", i.as_of)
    untouched = old.join(written.select("route_id"), "route_id", "left_anti")
    return stamped.unionByName(untouched).select("code", "name", "created_at", "updated_at")


def q_sessions_by_route(spark, sf_dir):
    """Distinct sessions a route from its daily sketches, held against the exact count."""
    pings = inputs(spark, sf_dir).pings
    daily = materialise(sessions.daily_sketches(pings), "session-sketches")
    merged = sessions.distinct_sessions(sessions.merge(daily, "route_id"))
    exact = pings.groupBy("route_id").agg(F.countDistinct("session_hash").alias("exact_sessions"))
    near = F.abs(F.col("sessions") - F.col("exact_sessions")) <= 0.03 * F.col("exact_sessions")
    return merged.join(exact, "route_id").select("route_id", "pings", "exact_sessions", near.alias("within_3_percent"))


QUERIES = {
    "sessions_by_route": q_sessions_by_route,
    "route_status": q_route_status,
    "units": q_units,
    "noise": q_noise,
    "ingested": q_ingested,
    "quarantine": q_quarantine,
    "live_age": q_live_age,
    "route_stats": q_route_stats,
    "live_total": q_live_total,
    "route_status_ordered": q_route_status_ordered,
    "route_answer": q_route_answer,
    "route_answer_first_stop": q_route_answer_first_stop,
    "route_payload": q_route_payload,
    "nearest_k_of_point": q_nearest_k_of_point,
    "purge_kept": q_purge_kept,
    "reload_unresolved": q_reload_unresolved,
    "stream_ingested": q_stream_ingested,
    "stream_counts": q_stream_counts,
    "stream_units": q_stream_units,
    "dashboard": q_dashboard,
    "active_routes": q_active_routes,
    "routes_by_kind": q_routes_by_kind,
    "route_search": q_route_search,
    "route_trace_stops": q_route_trace_stops,
    "route_geojson": q_route_geojson,
    "trace_endpoints": q_trace_endpoints,
    "trace_length": q_trace_length,
    "stops_per_route": q_stops_per_route,
    "nearest_from_point": q_nearest_from_point,
    "unit_nearest_stops": q_unit_nearest_stops,
    "within_radius": q_within_radius,
    "purge_report": q_purge_report,
    "sessions_like": q_sessions_like,
    "sessions_deleted": q_sessions_deleted,
    "stops_overwritten": q_stops_overwritten,
    "ingested_once": q_ingested_once,
    "quality_report": q_quality_report,
    "unit_labels": q_unit_labels,
    "route_bbox": q_route_bbox,
    "reload_stops": q_reload_stops,
    "routes_merged": q_routes_merged,
    "stops_after_cascade": q_stops_after_cascade,
    "routes_renamed": q_routes_renamed,
    "units_history": q_units_history,
    "audit_stamps": q_audit_stamps,
}

# ---------------------------------------------------------------- SQL side

_BASE = (O.DERIVED, O.SEGMENTS, O.INGEST, O.LIVE)
_UNITS = O.dbscan_sql("live_d", ["route_id"], "lv")

ORACLE = {
    "route_status": O.with_ctes(*_BASE, _UNITS, f"""
st AS ({O.knn_sql('lv_units', P.nearest_k)}),
st2 AS (SELECT st.*, r.code, r.kind FROM st JOIN routes_d r ON r.route_id = st.route_id AND r.active)""") + f"""
SELECT code, cluster_id, {O.R6('lat')} AS lat, {O.R6('lon')} AS lon, report_count, session_count, last_ts,
       CAST(stop_rank AS INTEGER) AS stop_rank, stop_name,
       {O.round_sql('distance_raw_m')} AS distance_m,
       {O.round_sql(f'distance_raw_m / ({O.SPEED})')} AS eta_minutes
FROM st2""",
    "units": O.with_ctes(*_BASE, _UNITS) + f"""
SELECT route_id, cluster_id, {O.R6('lon')} AS lon, {O.R6('lat')} AS lat, report_count, session_count, last_ts
FROM lv_units""",
    "noise": O.with_ctes(*_BASE, _UNITS) + """
SELECT ping_id, session_hash, route_id, lon, lat, ts FROM lv_lab WHERE label IS NULL""",
    "ingested": O.with_ctes(*_BASE) + """
SELECT ping_id, session_hash, route_id, lon, lat, ts FROM pings_d""",
    "quarantine": O.with_ctes(*_BASE) + """
SELECT ping_id, session_hash, code, lon, lat, ts, reject_reason FROM cls WHERE reject_reason IS NOT NULL""",
    "live_age": O.with_ctes(*_BASE) + f"""
SELECT p.ping_id, p.session_hash, r.code, p.lon, p.lat, p.ts,
       CAST(epoch_us({O.AS_OF}) - epoch_us(p.ts) AS DOUBLE) / 1000000e0 AS age_s
FROM live_d p JOIN routes_d r ON r.route_id = p.route_id""",
}

_STATS = f"""
lv_cnt AS (SELECT route_id, count(*) AS live_pings FROM live_d GROUP BY route_id),
lv_ucnt AS (SELECT route_id, count(*) AS units FROM lv_units GROUP BY route_id),
rstats AS (
  SELECT r.code, r.kind, coalesce(c.live_pings, 0) AS live_pings, coalesce(u.units, 0) AS units
  FROM routes_d r LEFT JOIN lv_cnt c ON c.route_id = r.route_id LEFT JOIN lv_ucnt u ON u.route_id = r.route_id
  WHERE r.active)"""

_TRACE_STOPS = """
tstops AS (
  SELECT r.code, s.name AS stop_name, s.seq, s.lat, s.lon,
         row_number() OVER (PARTITION BY s.route_id ORDER BY s.seq, s.stop_id) = 1 AS is_first,
         row_number() OVER (PARTITION BY s.route_id ORDER BY s.seq DESC, s.stop_id DESC) = 1 AS is_last
  FROM stops_d s JOIN routes_d r ON r.route_id = s.route_id AND r.active)"""

_SEG_LEN = f"""
seglen AS (
  SELECT route_id, sum({O.geodesic_sql('ax', 'ay', 'a_lat', 'bx', 'b_y', 'b_lat')}) / 1000e0 AS length_km
  FROM seg GROUP BY route_id)"""

_NEW_STOPS = """
nstops_0 AS (
  SELECT s.s_suppkey AS stop_id, CASE WHEN s.s_suppkey % 10 = 3 THEN 'RX' ELSE 'R' || CAST(n.n_regionkey AS VARCHAR) END AS code,
         'Nueva ' || s.s_name AS name,
         -103.45e0 + 0.01e0 * n.n_nationkey AS lon, 20.42e0 + s.s_acctbal / 30000e0 AS lat,
         CAST(row_number() OVER (PARTITION BY n.n_regionkey ORDER BY s.s_acctbal, s.s_suppkey) AS INTEGER) AS seq
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
  WHERE n.n_regionkey <= 1),
nstops AS (SELECT n.stop_id, r.route_id, n.name, n.lon, n.lat, n.seq
           FROM nstops_0 n JOIN routes_d r ON r.code = n.code),
stops_r AS (SELECT * FROM stops_d WHERE route_id NOT IN (SELECT route_id FROM nstops)
            UNION ALL SELECT * FROM nstops),
seg_r0 AS (
  SELECT route_id, lon AS a_lon, lat AS a_lat,
         lead(lon) OVER (PARTITION BY route_id ORDER BY seq, stop_id) AS b_lon,
         lead(lat) OVER (PARTITION BY route_id ORDER BY seq, stop_id) AS b_lat
  FROM stops_r)"""

ORACLE.update({
    "route_stats": O.with_ctes(*_BASE, _UNITS, _STATS) + """
SELECT code, kind, live_pings, units FROM rstats""",
    "live_total": O.with_ctes(*_BASE) + f"""
SELECT count(*) AS live_pings_total, {P.live_window_s // 60} AS window_minutes FROM pings_d
WHERE ts >= {O.LIVE_LOWER}""",
    "dashboard": O.with_ctes(*_BASE, _UNITS, _STATS) + """
SELECT CAST(coalesce(sum(units), 0) AS BIGINT) AS total_units,
       count(CASE WHEN live_pings > 0 THEN 1 END) AS routes_with_pings, count(*) AS n_routes FROM rstats""",
    "active_routes": O.with_ctes(O.DERIVED) + """
SELECT code, name, kind FROM routes_d WHERE active""",
    "routes_by_kind": O.with_ctes(O.DERIVED) + """
SELECT kind, n_routes, first_code, CAST(row_number() OVER (ORDER BY first_code) AS INTEGER) AS position
FROM (SELECT kind, count(*) AS n_routes, min(code) AS first_code FROM routes_d WHERE active GROUP BY kind)""",
    "route_search": O.with_ctes(O.DERIVED) + f"""
SELECT code, name, kind, active FROM routes_d
WHERE contains(lower(code), '{TERM}') OR contains(lower(name), '{TERM}')""",
    "route_trace_stops": O.with_ctes(O.DERIVED, _TRACE_STOPS) + """
SELECT * FROM tstops""",
    "route_geojson": O.with_ctes(O.DERIVED) + """
SELECT r.code, r.name, r.kind,
       CASE WHEN g.n >= 2 THEN '{"type":"LineString","coordinates":[' || g.coords || ']}' END AS geojson
FROM routes_d r LEFT JOIN (
  SELECT route_id, count(*) AS n,
         string_agg('[' || CAST(round(lon, 9) AS VARCHAR) || ',' || CAST(round(lat, 9) AS VARCHAR) || ']', ',' ORDER BY seq, stop_id) AS coords
  FROM stops_d GROUP BY route_id) g ON g.route_id = r.route_id
WHERE r.active""",
    "trace_endpoints": O.with_ctes(O.DERIVED) + """
SELECT r.code,
       'POINT(' || CAST(arg_min(s.lon, s.seq * 1e12 + s.stop_id) AS VARCHAR) || ' '
                || CAST(arg_min(s.lat, s.seq * 1e12 + s.stop_id) AS VARCHAR) || ')' AS start_wkt,
       'POINT(' || CAST(arg_max(s.lon, s.seq * 1e12 + s.stop_id) AS VARCHAR) || ' '
                || CAST(arg_max(s.lat, s.seq * 1e12 + s.stop_id) AS VARCHAR) || ')' AS end_wkt
FROM stops_d s JOIN routes_d r ON r.route_id = s.route_id
GROUP BY r.code HAVING count(*) >= 2""",
    "trace_length": O.with_ctes(O.DERIVED, O.SEGMENTS, _SEG_LEN) + f"""
SELECT r.code, {O.round_sql('l.length_km', 3)} AS length_km
FROM seglen l JOIN routes_d r ON r.route_id = l.route_id""",
    "stops_per_route": O.with_ctes(O.DERIVED) + """
SELECT r.code, coalesce(g.n, 0) AS n_stops, g.first_stop, g.last_stop
FROM routes_d r LEFT JOIN (
  SELECT route_id, count(*) AS n, arg_min(name, seq * 1e12 + stop_id) AS first_stop,
         arg_max(name, seq * 1e12 + stop_id) AS last_stop
  FROM stops_d GROUP BY route_id) g ON g.route_id = r.route_id""",
    "nearest_from_point": O.with_ctes(O.DERIVED, f"""
pt AS (SELECT route_id, code, {O.d(POINT[0])} AS lon, {O.d(POINT[1])} AS lat, route_id AS label
       FROM routes_d WHERE active),
kn AS ({O.knn_sql('pt', 5)})""") + f"""
SELECT code, CAST(stop_rank AS INTEGER) AS stop_rank, stop_name, {O.round_sql('distance_raw_m')} AS distance_m,
       {O.round_sql('distance_raw_m / 583e0')} AS eta_minutes FROM kn""",
    "unit_nearest_stops": O.with_ctes(*_BASE, _UNITS, f"""
kn AS ({O.knn_sql('lv_units', 2)})""") + f"""
SELECT route_id, cluster_id, report_count, CAST(stop_rank AS INTEGER) AS stop_rank, stop_name,
       {O.round_sql('distance_raw_m', 0)} AS dist_m, {O.round_sql('distance_raw_m / 583e0')} AS eta_min FROM kn""",
    "within_radius": O.with_ctes(*_BASE, f"""
pu AS ({O.utm_sql(f"(SELECT *, {O.d(POINT[0])} AS qlon, {O.d(POINT[1])} AS qlat FROM pings_d)", 'lon', 'lat', 'px', 'py')}),
pq AS ({O.utm_sql('pu', 'qlon', 'qlat', 'qx', 'qy')}),
pd AS (SELECT ping_id, route_id, {O.geodesic_sql('px', 'py', 'lat', 'qx', 'qy', 'qlat')} AS d FROM pq)""") + f"""
SELECT ping_id, route_id, {O.round_sql('d')} AS distance_m FROM pd WHERE d <= {O.d(RADIUS_M)}""",
    "purge_report": O.with_ctes(*_BASE) + f"""
SELECT count(*) AS purged,
       'OK: ' || CAST(count(*) AS VARCHAR) || ' pings purgados (antigüedad > 24 horas).' AS message
FROM pings_d WHERE ts < {O.AS_OF} - to_hours(24)""",
    "sessions_like": O.with_ctes(*_BASE) + f"""
SELECT ping_id, session_hash FROM pings_d WHERE NOT (session_hash LIKE '{PATTERN}')""",
    "quality_report": O.with_ctes(*_BASE, """
routes_q AS (SELECT * FROM routes_d UNION ALL SELECT 102, code, name, kind, active FROM routes_d WHERE route_id = 2
             UNION ALL SELECT route_id, 'R2b', NULL, kind, active FROM routes_d WHERE route_id = 3),
stops_q AS (SELECT stop_id, route_id, lon, lat, seq FROM stops_d
            UNION ALL SELECT stop_id, route_id + 200, lon, lat, seq FROM stops_d WHERE stop_id % 7 = 0
            UNION ALL SELECT stop_id + 1000000, route_id, NULL, lat, seq FROM stops_d WHERE stop_id % 11 = 0),
pings_q AS (SELECT * FROM pings_d
            UNION ALL SELECT ping_id, session_hash, route_id + 200, lon, lat, ts FROM pings_d WHERE ping_id % 50 = 1
            UNION ALL SELECT ping_id + 10000000, NULL, route_id, lon, 20.40e0, ts FROM pings_d WHERE ping_id % 40 = 3),
per_route AS (SELECT r.route_id, r.code, r.active, coalesce(c.n, 0) AS n_stops
              FROM routes_q r LEFT JOIN (SELECT route_id, count(*) AS n FROM stops_q GROUP BY route_id) c
              ON c.route_id = r.route_id)""") + f"""
SELECT 'route_kind_invalid' AS "check", code AS subject, CAST(1 AS BIGINT) AS n FROM routes_q
  WHERE kind IS NULL OR kind NOT IN ('tren_ligero', 'autobus', 'alimentador')
UNION ALL SELECT 'route_code_duplicate', code, count(*) FROM routes_q GROUP BY code HAVING count(*) > 1
UNION ALL SELECT 'route_id_duplicate', CAST(route_id AS VARCHAR), count(*) FROM routes_q GROUP BY route_id HAVING count(*) > 1
UNION ALL SELECT 'route_not_null', CAST(route_id AS VARCHAR), 1 FROM routes_q WHERE code IS NULL OR name IS NULL
UNION ALL SELECT 'stop_id_duplicate', CAST(stop_id AS VARCHAR), count(*) FROM stops_q GROUP BY stop_id HAVING count(*) > 1
UNION ALL SELECT 'stop_not_null', CAST(stop_id AS VARCHAR), 1 FROM stops_q WHERE route_id IS NULL OR lon IS NULL OR lat IS NULL
UNION ALL SELECT 'stop_orphan', CAST(stop_id AS VARCHAR), 1 FROM stops_q WHERE route_id NOT IN (SELECT route_id FROM routes_q)
UNION ALL SELECT 'stop_seq_duplicate', CAST(route_id AS VARCHAR) || '/' || CAST(seq AS VARCHAR), count(*)
  FROM stops_q GROUP BY route_id, seq HAVING count(*) > 1
UNION ALL SELECT 'ping_id_duplicate', CAST(ping_id AS VARCHAR), count(*) FROM pings_q GROUP BY ping_id HAVING count(*) > 1
UNION ALL SELECT 'ping_not_null', CAST(ping_id AS VARCHAR), 1 FROM pings_q
  WHERE session_hash IS NULL OR route_id IS NULL OR lon IS NULL OR lat IS NULL OR ts IS NULL
UNION ALL SELECT 'ping_orphan', CAST(ping_id AS VARCHAR), 1 FROM pings_q WHERE route_id NOT IN (SELECT route_id FROM routes_q)
UNION ALL SELECT 'ping_outside', CAST(ping_id AS VARCHAR), 1 FROM pings_q
  WHERE NOT (lon > {O.d(O.W)} AND lon < {O.d(O.E)} AND lat > {O.d(O.S)} AND lat < {O.d(O.N)})
UNION ALL SELECT 'active_route_without_trace', code, 1 FROM per_route WHERE active AND n_stops < 2
UNION ALL SELECT 'stops_per_route', code, n_stops FROM per_route""",
    "unit_labels": O.with_ctes(*_BASE, _UNITS, f"""
ul AS (SELECT *, CAST(floor(CAST(date_diff('millisecond', last_ts, {O.AS_OF}) AS DOUBLE) / 1000e0 + 5e-1) AS BIGINT) AS s
       FROM lv_units)""") + """
SELECT route_id, cluster_id, least(report_count / 5e0, 1e0) AS confidence,
       CASE WHEN report_count >= 3 THEN 'high' WHEN report_count = 2 THEN 'medium' ELSE 'low' END AS band,
       CASE WHEN last_ts IS NULL THEN 'justo ahora' WHEN s < 60 THEN 'hace ' || CAST(s AS VARCHAR) || 's'
            ELSE 'hace ' || CAST(CAST(floor(s / 60e0 + 5e-1) AS BIGINT) AS VARCHAR) || ' min' END AS age_label
FROM ul""",
    "route_bbox": O.with_ctes(O.DERIVED) + """
SELECT r.code, min(s.lat) AS south, min(s.lon) AS west, max(s.lat) AS north, max(s.lon) AS east,
       '[' || string_agg('[' || CAST(round(s.lat, 9) AS VARCHAR) || ',' || CAST(round(s.lon, 9) AS VARCHAR) || ']', ',' ORDER BY s.seq, s.stop_id) || ']' AS latlon
FROM stops_d s JOIN routes_d r ON r.route_id = s.route_id GROUP BY r.code HAVING count(*) >= 2""",
    "reload_stops": O.with_ctes(O.DERIVED, _NEW_STOPS, f"""
seg_r AS ({O.utm_sql(f"({O.utm_sql('(SELECT * FROM seg_r0 WHERE b_lon IS NOT NULL)', 'a_lon', 'a_lat', 'ax', 'ay')})", 'b_lon', 'b_lat', 'bx', 'b_y')}),
len_r AS (SELECT route_id, sum({O.geodesic_sql('ax', 'ay', 'a_lat', 'bx', 'b_y', 'b_lat')}) / 1000e0 AS length_km
          FROM seg_r GROUP BY route_id),
cnt_r AS (SELECT route_id, count(*) AS n, arg_min(name, seq * 1e12 + stop_id) AS first_stop,
                 arg_max(name, seq * 1e12 + stop_id) AS last_stop FROM stops_r GROUP BY route_id)""") + f"""
SELECT r.code, coalesce(c.n, 0) AS n_stops, c.first_stop, c.last_stop, {O.round_sql('l.length_km', 3)} AS length_km,
       CASE WHEN c.n >= 2 THEN md5('{{"type":"LineString","coordinates":[' || g.coords || ']}}') END AS line_md5,
       CASE WHEN r.route_id IN (SELECT route_id FROM nstops) THEN {O.AS_OF} ELSE (SELECT min(ts) FROM events) END AS updated_at
FROM routes_d r LEFT JOIN cnt_r c ON c.route_id = r.route_id LEFT JOIN len_r l ON l.route_id = r.route_id
LEFT JOIN (SELECT route_id, string_agg('[' || CAST(round(lon, 9) AS VARCHAR) || ',' || CAST(round(lat, 9) AS VARCHAR) || ']', ',' ORDER BY seq, stop_id) AS coords
           FROM stops_r GROUP BY route_id) g ON g.route_id = r.route_id""",
    "routes_merged": O.with_ctes(O.DERIVED, """
newr AS (
  SELECT 'R' || CAST(n_nationkey % 7 AS VARCHAR) AS code, n_name AS name,
         CASE WHEN n_nationkey % 3 = 0 THEN 'tren_ligero' WHEN n_nationkey % 3 = 1 THEN 'autobus' ELSE 'alimentador' END AS kind,
         true AS active, row_number() OVER (PARTITION BY 'R' || CAST(n_nationkey % 7 AS VARCHAR) ORDER BY n_nationkey) AS rn
  FROM nation)""") + """
SELECT code, name, kind, active FROM routes_d
UNION ALL
SELECT code, name, kind, active FROM newr WHERE rn = 1 AND code NOT IN (SELECT code FROM routes_d)""",
    "stops_after_cascade": O.with_ctes(O.DERIVED) + """
SELECT route_id, count(*) AS n_stops FROM stops_d
WHERE route_id IN (SELECT route_id FROM routes_d WHERE active) GROUP BY route_id""",
    "routes_renamed": O.with_ctes(O.DERIVED) + f"""
SELECT code, CASE WHEN code = '{RENAME[0]}' THEN '{RENAME[1]}' ELSE name END AS name, kind, active FROM routes_d""",
    "units_history": O.with_ctes(*_BASE[:3], """
hist AS (SELECT p.*, CAST(p.ts AS DATE) AS day FROM pings_d p
         WHERE p.route_id IN (SELECT route_id FROM routes_d WHERE active))""",
                                 O.dbscan_sql("hist", ["route_id", "day"], "hs")) + f"""
SELECT route_id, day, cluster_id, {O.R6('lon')} AS lon, {O.R6('lat')} AS lat, report_count, session_count, last_ts
FROM hs_units""",
})

ORACLE["audit_stamps"] = O.with_ctes(O.DERIVED) + f"""
SELECT code, CASE WHEN code = '{RENAME[0]}' THEN '{RENAME[1]}' ELSE name END AS name,
       (SELECT min(ts) FROM events) AS created_at,
       CASE WHEN code IN ('R1', 'R2') THEN {O.AS_OF} ELSE (SELECT min(ts) FROM events) END AS updated_at
FROM routes_d"""

_STATUS = f"""
st AS ({O.knn_sql('lv_units', P.nearest_k)}),
status AS (SELECT r.route_id, r.code, st.cluster_id, {O.R6('st.lat')} AS lat, {O.R6('st.lon')} AS lon, st.report_count, st.last_ts,
                  CAST(st.stop_rank AS INTEGER) AS stop_rank, st.stop_name, {O.round_sql('st.distance_raw_m')} AS distance_m,
                  {O.round_sql(f'st.distance_raw_m / ({O.SPEED})')} AS eta_minutes
           FROM st JOIN routes_d r ON r.route_id = st.route_id AND r.active)"""


def _answers(max_stops: int) -> str:
    return f"""
SELECT r.code, coalesce(u.total, 0) AS total,
       '{{"ruta":"' || r.code || '","unidades":[' || coalesce(u.units, '') || '],"total":' || coalesce(u.total, 0) || '}}' AS answer
FROM routes_d r LEFT JOIN (
  SELECT route_id, CAST(count(*) AS INTEGER) AS total, string_agg(unit, ',' ORDER BY last_ts DESC, near, cluster_id) AS units FROM (
    SELECT route_id, cluster_id, max(last_ts) AS last_ts, min(distance_m) AS near,
      '{{"unidad_id":' || cluster_id || ',"posicion":{{"lat":' || any_value(lat) || ',"lon":' || any_value(lon) || '}},"confianza":' || any_value(report_count)
      || ',"ultima_actualizacion":"' || strftime(max(last_ts), '%Y-%m-%dT%H:%M:%S.%f') || '","proximas_paradas":['
      || string_agg('{{"nombre":"' || stop_name || '","distancia_m":' || distance_m || ',"eta_minutos":' || eta_minutes || '}}', ',' ORDER BY distance_m, stop_rank)
         FILTER (k <= {max_stops}) || ']}}' AS unit
    FROM (SELECT *, row_number() OVER (PARTITION BY route_id, cluster_id ORDER BY distance_m, stop_rank) AS k FROM status)
    GROUP BY route_id, cluster_id) GROUP BY route_id) u ON u.route_id = r.route_id
WHERE r.active"""


ORACLE.update({
    "route_status_ordered": O.with_ctes(*_BASE, _UNITS, _STATUS) + """
SELECT code, CAST(row_number() OVER (PARTITION BY code ORDER BY last_ts DESC, distance_m, cluster_id, stop_rank) AS INTEGER) AS position,
       cluster_id, last_ts, stop_name, distance_m FROM status""",
    "route_answer": O.with_ctes(*_BASE, _UNITS, _STATUS) + _answers(P.nearest_k),
    "route_answer_first_stop": O.with_ctes(*_BASE, _UNITS, _STATUS) + _answers(1),
    "route_payload": O.with_ctes(O.DERIVED) + """
SELECT r.code, '{"clave":"' || r.code || '","nombre":"' || r.name || '","tipo":"' || r.kind || '","trazado":'
       || CASE WHEN g.n >= 2 THEN '{"type":"LineString","coordinates":[' || g.coords || ']}' ELSE 'null' END
       || ',"paradas":[' || coalesce(g.items, '') || ']}' AS payload
FROM routes_d r LEFT JOIN (
  SELECT route_id, count(*) AS n,
         string_agg('[' || CAST(round(lon, 9) AS VARCHAR) || ',' || CAST(round(lat, 9) AS VARCHAR) || ']', ',' ORDER BY seq, stop_id) AS coords,
         string_agg('{"nombre":"' || name || '","orden":' || seq || ',"lat":' || lat || ',"lon":' || lon || '}', ',' ORDER BY seq, stop_id) AS items
  FROM stops_d GROUP BY route_id) g ON g.route_id = r.route_id
WHERE r.active""",
    "nearest_k_of_point": O.with_ctes(O.DERIVED) + f"""
SELECT stop_id, route_id, name, {O.R6(O.degdist_sql(O.d(POINT[0]), O.d(POINT[1]), 'lon', 'lat'))} AS distance_deg
FROM stops_d ORDER BY {O.degdist_sql(O.d(POINT[0]), O.d(POINT[1]), 'lon', 'lat')}, seq, stop_id LIMIT 7""",
    "purge_kept": O.with_ctes(*_BASE) + f"""
SELECT ping_id, session_hash, route_id, lon, lat, ts FROM pings_d WHERE NOT (ts < {O.AS_OF} - to_hours(24))""",
    "reload_unresolved": O.with_ctes(O.DERIVED, _NEW_STOPS) + """
SELECT stop_id, code, name FROM nstops_0 WHERE code NOT IN (SELECT code FROM routes_d)""",
    "sessions_deleted": O.with_ctes(*_BASE) + f"""
SELECT ping_id, session_hash, route_id, lon, lat, ts FROM pings_d WHERE NOT (session_hash LIKE '{PATTERN}')""",
    "stops_overwritten": O.with_ctes(O.DERIVED, _NEW_STOPS) + f"""
SELECT stop_id, route_id, name, seq, {O.R6('lon')} AS lon, {O.R6('lat')} AS lat FROM stops_r""",
    "ingested_once": O.with_ctes(*_BASE) + """
SELECT ping_id, reject_reason FROM cls""",
    "stream_ingested": O.with_ctes(*_BASE) + """
SELECT ping_id, session_hash, code, lon, lat, ts, reject_reason FROM cls""",
    "sessions_by_route": O.with_ctes(*_BASE) + """
SELECT route_id, count(*) AS pings, count(DISTINCT session_hash) AS exact_sessions, true AS within_3_percent
FROM pings_d GROUP BY route_id""",
    "stream_units": O.with_ctes(O.DERIVED, O.SEGMENTS, O.INGEST, O.LIVE.replace(O.AS_OF, "(SELECT max(ts) FROM pings_d)"), _UNITS) + f"""
SELECT route_id, cluster_id, {O.R6('lon')} AS lon, {O.R6('lat')} AS lat, report_count, session_count, last_ts
FROM lv_units""",
    "stream_counts": O.with_ctes(*_BASE) + """
SELECT s AS window_start_s, route_id, count(*) AS pings FROM (
  SELECT route_id, unnest(range((CAST(epoch_us(ts) AS BIGINT) // 30000000) * 30 - 90, (CAST(epoch_us(ts) AS BIGINT) // 30000000) * 30 + 30, 30)) AS s FROM pings_d)
GROUP BY s, route_id""",
})
