"""Live window, purge, pattern delete, dimension rewrites, traces."""
import datetime as dt

import fixtures as fx
from pyspark.sql import functions as F

from pingpath.operators import dims, live, quality, traces
from pingpath.sources.tables import PINGS

AS_OF = fx.AS_OF


def _pings(spark, offsets, sessions=None):
    sessions = sessions or [f"s{i}" for i in range(len(offsets))]
    rows = [(i, s, 1, -103.35, 20.65, AS_OF + dt.timedelta(seconds=o)) for i, (o, s) in enumerate(zip(offsets, sessions))]
    return spark.createDataFrame(rows, PINGS)


def test_live_window_edges(spark):
    p = _pings(spark, [-120, -120.000001, 60])
    assert [r.ping_id for r in live.live_pings(p, AS_OF, 120).orderBy("ping_id").collect()] == [0, 2]


def test_purge_edges(spark):
    p = _pings(spark, [-24 * 3600, -24 * 3600 - 1, -1, 0])
    kept, purged = live.purge(p, AS_OF, 24)
    assert sorted(r.ping_id for r in kept.collect()) == [0, 2, 3]
    kept0, _ = live.purge(p, AS_OF, 0)
    assert sorted(r.ping_id for r in kept0.collect()) == [3]
    msg = live.purge_report(p, AS_OF, 24).first()
    assert msg.purged == 1 and msg.message == "OK: 1 pings purgados (antigüedad > 24 horas)."


def test_like_pattern(spark):
    p = _pings(spark, [0, 0, 0], ["demo_x", "demo", "demoXY"])
    assert sorted(r.session_hash for r in live.delete_sessions_like(p, "demo_%").collect()) == ["demo"]


def test_insert_if_absent_and_replace(spark):
    routes = fx.routes_df(spark).withColumn("_o", F.lit(0))
    new = spark.createDataFrame([("L1", "otra", "autobus", True, 1), ("N1", "nueva", "autobus", True, 2),
                                 ("N1", "dup", "autobus", True, 3)], "code string, name string, kind string, active boolean, _o int")
    merged = dims.insert_if_absent(routes, new, "code", "_o")
    got = {r.code: r.name for r in merged.collect()}
    assert got["N1"] == "nueva" and got["L1"].startswith("Línea 1") and len(got) == 5
    stops = fx.stops_df(spark)
    repl = stops.where("route_id = 4").limit(2).withColumn("name", F.lit("x"))
    out = dims.replace_by_key(stops, repl, "route_id")
    assert out.where("route_id = 4").count() == 2 and out.where("route_id = 1").count() == 20


def test_cascade_update_audit(spark):
    routes, stops = fx.routes_df(spark), fx.stops_df(spark)
    assert dims.cascade_delete(stops, routes.where("code <> 'L1'"), "route_id").count() == 16
    patch = spark.createDataFrame([("C-09", "Ruta C-09 nueva")], "code string, name string")
    ren = {r.code: r.name for r in dims.update_attribute(routes, patch, "code").collect()}
    assert ren["C-09"] == "Ruta C-09 nueva" and ren["L1"].startswith("Línea 1")
    t0 = dt.datetime(2026, 4, 1)
    old = routes.withColumn("created_at", F.lit(t0)).withColumn("updated_at", F.lit(t0))
    written = routes.where("code = 'L1'")          # same values written again
    st = dims.stamp_audit(written, old, "route_id", AS_OF).first()
    assert st.created_at == t0 and st.updated_at == AS_OF


def test_traces_and_reload(spark):
    stops, routes = fx.stops_df(spark), fx.routes_df(spark)
    km = {r.route_id: round(r.length_km, 2) for r in traces.trace_length(stops).collect()}
    assert km == {1: 16.55, 2: 10.11, 3: 4.59, 4: 5.18}
    ends = {r.route_id: (r.start_wkt, r.end_wkt) for r in traces.endpoints_wkt(traces.build_traces(stops)).collect()}
    assert ends[1] == ("POINT(-103.3494 20.7381)", "POINT(-103.4011 20.6067)")
    one = stops.where("route_id = 4 AND seq = 1")
    upd = dims.update_from_aggregate(routes, stops.where("route_id <> 4").unionByName(one))
    assert upd.where("route_id = 4").first().trace is None
    new = spark.createDataFrame([("A04", "a", -103.40, 20.60, 1), ("A04", "b", -103.41, 20.59, 2)],
                                "code string, name string, lon double, lat double, seq int").withColumn("stop_id", F.lit(99).cast("long"))
    lost = spark.createDataFrame([("NO", "c", -103.40, 20.60, 1)], "code string, name string, lon double, lat double, seq int").withColumn("stop_id", F.lit(100).cast("long"))
    _, new_stops, report, unresolved = dims.reload_stops(routes, stops, new.unionByName(lost))
    assert [(r.stop_id, r.code) for r in unresolved.collect()] == [(100, "NO")]
    rep = {r.code: r.n_stops for r in report.collect()}
    assert rep == {"L1": 20, "L3": 5, "C-09": 6, "A04": 2}


def test_quality_report(spark):
    routes, stops = fx.routes_df(spark), fx.stops_df(spark)
    rows = {(r.check, r.subject): r.n for r in quality.quality_report(routes, stops).collect()}
    assert rows[("stops_per_route", "L1")] == 20
    assert not [k for k in rows if k[0] != "stops_per_route"]
