"""Golden values on the seed routes and the 18 demo pings (FIXTURES.md §3)."""
import fixtures as fx
from pingpath.sources.tables import PINGS


from pingpath.config import Params
from pingpath.operators import live, stats
from pingpath.plans import service


def _demo(spark):
    return fx.demo_pings_df(spark), fx.routes_df(spark), fx.stops_df(spark)


def test_route_status_golden(spark):
    pings, routes, stops = _demo(spark)
    rows = service.route_status_ordered(service.route_status(pings, routes, stops, fx.AS_OF)).collect()
    got = [(r.code, r.report_count, r.stop_name, r.distance_m, r.eta_minutes) for r in rows]
    assert got == [
        ("L3", 3, "Plaza de la Bandera", 0.0, 0.0), ("L3", 3, "Central de Autobuses", 1180.0, 2.0),
        ("L3", 3, "Ávila Camacho (Transbordo L1)", 4812.8, 8.3),
        ("C-09", 3, "Centro Sur", 0.0, 0.0), ("C-09", 3, "Camino Real a Colima", 888.6, 3.0),
        ("C-09", 3, "Loma Bonita", 1807.5, 6.0),
        ("L1", 4, "Juárez", 5.5, 0.0), ("L1", 4, "Refugio", 653.0, 1.1), ("L1", 4, "Mexicaltzingo", 891.8, 1.5),
        ("L1", 3, "Mexicaltzingo", 0.0, 0.0), ("L1", 3, "Washington", 625.6, 1.1), ("L1", 3, "Juárez", 886.3, 1.5),
        ("C-09", 2, "Loma Bonita", 7.6, 0.0), ("C-09", 2, "Camino Real a Colima", 911.3, 3.0),
        ("C-09", 2, "El Vergel", 941.6, 3.1),
        ("L1", 2, "Ávila Camacho", 7.6, 0.0), ("L1", 2, "División del Norte", 925.2, 1.6),
        ("L1", 2, "Mezquitán", 935.1, 1.6),
    ]
    l1 = [r for r in rows if r.code == "L1" and r.report_count == 4][0]
    assert abs(l1.lon - -103.3547) < 1e-9 and abs(l1.lat - 20.67475) < 1e-9
    assert {r.cluster_id for r in rows if r.code == "L1"} == {0, 1, 2}


def test_noise_is_the_isolated_ping(spark):
    pings, routes, _ = _demo(spark)
    n = service.noise(pings, routes, fx.AS_OF).collect()
    assert [r.session_hash for r in n] == ["demo_noise"]


def test_statistics(spark):
    pings, routes, _ = _demo(spark)
    per_route, total, dash = service.system_stats(pings, routes, fx.AS_OF)
    got = {r.code: (r.live_pings, r.units) for r in per_route.collect()}
    assert got == {"L1": (10, 3), "C-09": (5, 2), "L3": (3, 1), "A04": (0, 0)}
    assert total.first().live_pings_total == 18
    d = dash.first()
    assert (d.total_units, d.routes_with_pings, d.n_routes) == (6, 3, 4)


def test_five_nearest_from_point(spark):
    _, routes, stops = _demo(spark)
    n = service.nearest_from_point(stops, routes.where("code = 'L1'"), -103.3547, 20.6747, 5, 583.0)
    got = [(r.stop_name, r.distance_m, r.eta_minutes) for r in n.orderBy("stop_rank").collect()]
    assert got == [("Juárez", 0.0, 0.0), ("Refugio", 658.5, 1.1), ("Mexicaltzingo", 886.3, 1.5),
                   ("Washington", 1510.0, 2.6), ("Mezquitán", 1584.5, 2.7)]


def test_unit_with_two_stops_rounds_to_metres(spark):
    pings, routes, stops = _demo(spark)
    n = service.unit_nearest_stops(pings, routes, stops, fx.AS_OF).where("route_id = 1 AND cluster_id = 0")
    assert [r.distance_m for r in n.orderBy("stop_rank").collect()] == [6.0, 653.0]


def test_degree_ranking_differs_from_metres(spark):
    # one stop nearer in degrees (east-west), the other nearer in metres (north-south)
    routes = fx.routes_df(spark)
    stops = spark.createDataFrame(
        [(1, 1, "east", -103.35375, 20.67475, 1), (2, 1, "north", -103.35475, 20.67571, 2)], "stop_id long, route_id int, name string, lon double, lat double, seq int")
    pings = fx.demo_pings_df(spark).where("session_hash IN ('demo_a1', 'demo_a2')")
    deg = service.route_status(pings, routes, stops, fx.AS_OF).where("stop_rank = 1").first()
    met = service.route_status(pings, routes, stops, fx.AS_OF, metric="metres").where("stop_rank = 1").first()
    assert (deg.stop_name, met.stop_name) == ("north", "east")


def test_route_without_stops_drops_units(spark):
    pings, routes, stops = _demo(spark)
    st = service.route_status(pings, routes, stops.where("route_id <> 3"), fx.AS_OF)
    assert st.where("code = 'C-09'").count() == 0
    assert service.units(pings, routes, fx.AS_OF).where("route_id = 3").count() == 2


def test_one_session_makes_a_unit_with_session_count_one(spark):
    import datetime as dt
    routes = fx.routes_df(spark)
    rows = [(1, "solo", 1, -103.3547, 20.6747, fx.AS_OF - dt.timedelta(seconds=20)),
            (2, "solo", 1, -103.3547, 20.6747, fx.AS_OF - dt.timedelta(seconds=10))]
    pings = spark.createDataFrame(rows, PINGS)
    u = service.units(pings, routes, fx.AS_OF).first()
    assert (u.report_count, u.session_count) == (2, 1)


def test_labels_and_search(spark):
    pings, routes, _ = _demo(spark)
    lab = stats.unit_labels(service.units(pings, routes, fx.AS_OF), fx.AS_OF)
    got = {(r.route_id, r.cluster_id): (r.band, r.age_label, r.confidence) for r in lab.collect()}
    assert got[(1, 0)] == ("high", "hace 10s", 0.8)
    assert got[(1, 2)] == ("medium", "hace 40s", 0.4)
    assert [r.code for r in stats.search_routes(routes, "tren").collect()] == ["L1", "L3"]
    kinds = [(r.kind, r.n_routes) for r in stats.routes_by_kind(routes).collect()]
    assert [r.position for r in stats.routes_by_kind(routes).collect()] == [1, 2, 3]
    assert kinds == [("alimentador", 1), ("autobus", 1), ("tren_ligero", 2)]


def test_radius(spark):
    pings = fx.demo_pings_df(spark)
    got = live.within_radius(pings, -103.3547, 20.6747, 500.0).select("session_hash").collect()
    assert sorted(r.session_hash for r in got) == ["demo_a1", "demo_a2", "demo_a3", "demo_a4"]


def test_nested_answers(spark):
    """Golden nested answer: units newest first, stops by distance, empty and unknown routes."""
    import json

    import pytest
    pings, routes, stops = _demo(spark)
    status = service.route_status(pings, routes, stops, fx.AS_OF)
    answers = service.route_answers(status, routes)
    l1 = json.loads(service.answer_for(answers, "L1"))
    assert l1["ruta"] == "L1" and l1["total"] == 3
    assert [(u["unidad_id"], u["confianza"]) for u in l1["unidades"]] == [(0, 4), (1, 3), (2, 2)]
    assert [s["nombre"] for s in l1["unidades"][0]["proximas_paradas"]] == ["Juárez", "Refugio", "Mexicaltzingo"]
    assert l1["unidades"][0]["proximas_paradas"][0] == {"nombre": "Juárez", "distancia_m": 5.5, "eta_minutos": 0.0}
    assert json.loads(service.answer_for(answers, "A04")) == {"ruta": "A04", "unidades": [], "total": 0}
    with pytest.raises(LookupError):
        service.answer_for(answers, "ZZ")
    first = json.loads(service.answer_for(service.route_answers(status, routes, max_stops=1), "L1"))
    assert [len(u["proximas_paradas"]) for u in first["unidades"]] == [1, 1, 1]


def test_route_payload(spark):
    import json
    _, routes, stops = _demo(spark)
    got = {r.code: json.loads(r.payload) for r in service.route_payloads(routes, stops.where("route_id <> 4")).collect()}
    assert got["L3"]["trazado"]["coordinates"][0] == [-103.3175, 20.655] and len(got["L3"]["paradas"]) == 5
    assert got["A04"]["trazado"] is None and got["A04"]["paradas"] == []


def test_nearest_stops_match_a_full_ranking(spark):
    """The grid gives what ranking every stop of the route gives, for near, far and lone points."""
    import random

    from pingpath.operators import nearest
    rnd = random.Random(4)
    stops = [(i, i % 3 + 1, f"p{i}", -103.4 + rnd.random() * 0.1, 20.5 + rnd.random() * 0.1, i) for i in range(300)]
    stops += [(900, 4, "lone", -103.2, 20.8, 1)]
    points = [(i, i % 5 + 1, -103.5 + rnd.random() * 0.3, 20.4 + rnd.random() * 0.4) for i in range(60)]
    st = spark.createDataFrame(stops, "stop_id long, route_id int, name string, lon double, lat double, seq int")
    pt = spark.createDataFrame(points, "point long, route_id int, lon double, lat double")
    got = {}
    for r in nearest.nearest_stops(pt, st, 3).collect():
        got.setdefault(r.point, {})[r.stop_rank] = r.stop_id
    want = {}
    for i, route, lon, lat in points:
        ranked = sorted((((s[3] - lon) ** 2 + (s[4] - lat) ** 2) ** 0.5, s[5], s[0]) for s in stops if s[1] == route)
        if ranked:
            want[i] = {k + 1: r[2] for k, r in enumerate(ranked[:3])}
    assert got == want
    assert [r.stop_id for r in nearest.nearest_of_point(st, -103.2, 20.8, 1).collect()] == [900]
