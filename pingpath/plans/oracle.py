"""Independent SQL (DuckDB dialect) for the registered queries.

Written from the semantics, not generated from the Spark plans: the derived
tables, the validation order, the rate-limit fold (recursive CTE, one step per
attempt), DBSCAN as all pairs within eps plus a recursive transitive closure,
and the nearest stops by ``row_number()``.  The geodesy uses the same closed
formulas as ``pingpath.functions.geo``; doubles are written in exponent form so
DuckDB reads DOUBLE, not DECIMAL.
"""

from __future__ import annotations

from pingpath import config as C
from pingpath.functions import geo
from pingpath.sources.driver import DRIVER_PARAMS

P = DRIVER_PARAMS


def d(v: float) -> str:
    return "%.17e" % float(v)


def utm_sql(src: str, lon: str, lat: str, x: str, y: str) -> str:
    """SELECT adding UTM columns x, y to the rows of ``src`` (a FROM item)."""
    east, north = "_eta", "_xi"
    for j, a in enumerate(geo.ALPHA, start=1):
        east = f"({east} + {d(a)} * cos(_xi * {2 * j}) * sinh(_eta * {2 * j}))"
        north = f"({north} + {d(a)} * sin(_xi * {2 * j}) * cosh(_eta * {2 * j}))"
    e = d(geo.CONST["e"])
    s1 = (f"SELECT *, sinh(atanh(sin(radians({lat}))) - {e} * atanh({e} * sin(radians({lat})))) AS _t, "
          f"radians({lon}) - {d(geo.CONST['lon0'])} AS _lam FROM {src}")
    s2 = f"SELECT *, atan(_t / cos(_lam)) AS _xi, atanh(sin(_lam) / sqrt(1e0 + _t * _t)) AS _eta FROM ({s1})"
    return (f"SELECT * EXCLUDE (_t, _lam, _xi, _eta), {d(geo.UTM_FALSE_EASTING)} + {d(geo.CONST['ka'])} * {east} AS {x}, "
            f"{d(geo.UTM_FALSE_NORTHING)} + {d(geo.CONST['ka'])} * {north} AS {y} FROM ({s2})")


def lonlat_sql(src: str, x: str, y: str, lon: str, lat: str) -> str:
    xi1, eta1 = "_xi", "_eta"
    for j, b in enumerate(geo.BETA, start=1):
        xi1 = f"({xi1} - {d(b)} * sin(_xi * {2 * j}) * cosh(_eta * {2 * j}))"
        eta1 = f"({eta1} - {d(b)} * cos(_xi * {2 * j}) * sinh(_eta * {2 * j}))"
    phi = "_chi"
    for j, dd in enumerate(geo.DELTA, start=1):
        phi = f"({phi} + {d(dd)} * sin(_chi * {2 * j}))"
    ka = d(geo.CONST["ka"])
    s1 = (f"SELECT *, ({y} - {d(geo.UTM_FALSE_NORTHING)}) / {ka} AS _xi, "
          f"({x} - {d(geo.UTM_FALSE_EASTING)}) / {ka} AS _eta FROM {src}")
    s2 = f"SELECT *, {xi1} AS _xi1, {eta1} AS _eta1 FROM ({s1})"
    s3 = f"SELECT *, asin(sin(_xi1) / cosh(_eta1)) AS _chi FROM ({s2})"
    lam = f"({d(geo.CONST['lon0'])} + atan(sinh(_eta1) / cos(_xi1)))"
    return (f"SELECT * EXCLUDE (_xi, _eta, _xi1, _eta1, _chi), degrees({lam}) AS {lon}, "
            f"degrees({phi}) AS {lat} FROM ({s3})")


def scale_sql(x: str, lat: str) -> str:
    e2, k0 = d(geo.CONST["e2"]), d(geo.UTM_K0)
    w = f"(1e0 - {e2} * sin(radians({lat})) * sin(radians({lat})))"
    rho_nu = f"({d(geo.WGS84_A * geo.WGS84_A * (1 - geo.CONST['e2']))} / ({w} * {w}))"
    u = f"(({x} - {d(geo.UTM_FALSE_EASTING)}) / {k0})"
    q = f"({u} * {u} / {rho_nu})"
    return f"({k0} * (1e0 + {q} / 2 + {q} * {q} / 24))"


def geodesic_sql(x1, y1, lat1, x2, y2, lat2) -> str:
    grid = f"sqrt(({x2} - {x1}) * ({x2} - {x1}) + ({y2} - {y1}) * ({y2} - {y1}))"
    km = scale_sql(f"(({x1} + {x2}) / 2)", f"(({lat1} + {lat2}) / 2)")
    return f"({grid} * 6e0 / ({scale_sql(x1, lat1)} + {km} * 4e0 + {scale_sql(x2, lat2)}))"


def segdist_sql(px, py, plat, ax, ay, bx, by) -> str:
    dx, dy = f"({bx} - {ax})", f"({by} - {ay})"
    len2 = f"({dx} * {dx} + {dy} * {dy})"
    t = f"(CASE WHEN {len2} > 0 THEN (({px} - {ax}) * {dx} + ({py} - {ay}) * {dy}) / {len2} ELSE 0e0 END)"
    t = f"greatest(0e0, least(1e0, {t}))"
    cx, cy = f"({ax} + {t} * {dx})", f"({ay} + {t} * {dy})"
    grid = f"sqrt(({px} - {cx}) * ({px} - {cx}) + ({py} - {cy}) * ({py} - {cy}))"
    return f"({grid} / {scale_sql(px, plat)})"


def round_sql(x: str, digits: int = 1) -> str:
    s = d(10 ** digits)
    return f"(floor({x} * {s} + 5e-1) / {s})"


def degdist_sql(lon1, lat1, lon2, lat2) -> str:
    return f"sqrt(({lon2} - {lon1}) * ({lon2} - {lon1}) + ({lat2} - {lat1}) * ({lat2} - {lat1}))"


AS_OF = "(SELECT max(ts) FROM events)"
LIVE_LOWER = f"({AS_OF} - to_seconds({P.live_window_s}))"

SPEED = ("CASE " + " ".join(f"WHEN kind = '{k}' THEN {d(v)}" for k, v in C.SPEEDS_M_PER_MIN.items())
         + f" ELSE {d(C.DEFAULT_SPEED_M_PER_MIN)} END")

W, S, E, N = C.ENVELOPE

DERIVED = f"""
routes_d AS (
  SELECT CAST(r_regionkey + 1 AS INTEGER) AS route_id, 'R' || CAST(r_regionkey AS VARCHAR) AS code,
         r_name AS name,
         CASE WHEN r_regionkey % 3 = 0 THEN 'tren_ligero' WHEN r_regionkey % 3 = 1 THEN 'autobus'
              ELSE 'alimentador' END AS kind,
         r_regionkey <> 4 AS active
  FROM region
  UNION ALL SELECT 6, 'R5', r_name || ' BIS', 'teleferico', true FROM region WHERE r_regionkey = 0),
stops_0 AS (
  SELECT s_suppkey AS stop_id, CAST(n_regionkey + 1 AS INTEGER) AS route_id, s_name AS name, n_regionkey,
         row_number() OVER (PARTITION BY n_regionkey ORDER BY s_suppkey) AS seq,
         count(*) OVER (PARTITION BY n_regionkey) AS cnt
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
stops_d AS (
  SELECT stop_id, route_id, name,
         -103.50e0 + 0.07e0 * n_regionkey + 0.002e0 * (seq % 3) AS lon,
         20.45e0 + 0.35e0 * seq / (cnt + 1) AS lat,
         CAST(seq AS INTEGER) AS seq
  FROM stops_0),
cnts AS (SELECT route_id, count(*) AS cnt FROM stops_d GROUP BY route_id),
ev AS (
  SELECT e.event_id, e.ts, e.user_id, e.event_type, e.value, CAST(e.event_id % 6 + 1 AS INTEGER) AS route_id
  FROM events e),
ev2 AS (
  SELECT ev.*, CAST((ev.event_id // 6) % c.cnt + 1 AS INTEGER) AS seq
  FROM ev LEFT JOIN cnts c ON c.route_id = ev.route_id),
raw_d AS (
  SELECT ev2.event_id AS ping_id,
         CASE WHEN ev2.event_id % 97 = 3 THEN 'd-' || CAST(ev2.user_id % 1000 AS VARCHAR)
              ELSE 'device-' || repeat('0', greatest(0, 6 - length(CAST(ev2.user_id AS VARCHAR)))) || CAST(ev2.user_id AS VARCHAR) END AS uuid,
         'R' || CAST(ev2.event_id % 6 AS VARCHAR) || CASE WHEN ev2.event_id % 89 = 7 THEN '-TOO-LONG' ELSE '' END AS code,
         CASE WHEN ev2.event_type = 'error'
              THEN coalesce(s.lon, -103.35e0) + ((ev2.event_id * 7) % 5 - 2) * 0.00005e0 + 0.005e0
              ELSE coalesce(s.lon, -103.35e0) + ((ev2.event_id * 7) % 5 - 2) * 0.00005e0 END AS lon,
         CASE WHEN ev2.value > 150 THEN 20.39e0
              WHEN ev2.route_id = 6 AND ev2.event_id % 11 = 5 THEN 20.40e0
              ELSE coalesce(s.lat, 20.6e0) + ((ev2.event_id * 11) % 7 - 3) * 0.00004e0 END AS lat,
         CASE WHEN ev2.event_id % 83 <> 11 THEN ev2.ts END AS ts
  FROM ev2 LEFT JOIN stops_d s ON s.route_id = ev2.route_id AND s.seq = ev2.seq)"""

SEGMENTS = f"""
seg0 AS (
  SELECT route_id, lon AS a_lon, lat AS a_lat,
         lead(lon) OVER (PARTITION BY route_id ORDER BY seq, stop_id) AS b_lon,
         lead(lat) OVER (PARTITION BY route_id ORDER BY seq, stop_id) AS b_lat,
         row_number() OVER (PARTITION BY route_id ORDER BY seq, stop_id) AS seg_idx
  FROM stops_d),
seg AS ({utm_sql(f"({utm_sql('(SELECT * FROM seg0 WHERE b_lon IS NOT NULL)', 'a_lon', 'a_lat', 'ax', 'ay')})",
                 'b_lon', 'b_lat', 'bx', 'b_y')}),
traced AS (SELECT route_id FROM stops_d GROUP BY route_id HAVING count(*) >= 2)"""

INGEST = f"""
cls0 AS (
  SELECT r.ping_id, r.code, r.lon, r.lat, r.ts,
         sha256(r.uuid || ':' || '{P.salt}') AS session_hash,
         CASE WHEN r.uuid IS NULL OR length(r.uuid) NOT BETWEEN {C.UUID_LEN_MIN} AND {C.UUID_LEN_MAX} THEN 'payload_uuid'
              WHEN r.code IS NULL OR length(r.code) NOT BETWEEN {C.CODE_LEN_MIN} AND {C.CODE_LEN_MAX} THEN 'payload_code'
              WHEN r.lat IS NULL OR r.lon IS NULL
                   OR r.lat NOT BETWEEN {d(C.PAYLOAD_LAT_MIN)} AND {d(C.PAYLOAD_LAT_MAX)}
                   OR r.lon NOT BETWEEN {d(C.PAYLOAD_LON_MIN)} AND {d(C.PAYLOAD_LON_MAX)} THEN 'payload_bounds'
              WHEN r.ts IS NULL THEN 'payload_ts'
         END AS payload_reason,
         a.route_id
  FROM raw_d r LEFT JOIN (SELECT code, route_id FROM routes_d WHERE active) a ON a.code = r.code),
cls_u AS ({utm_sql('cls0', 'lon', 'lat', 'px', 'py')}),
cdist AS (
  SELECT c.ping_id, min({segdist_sql('c.px', 'c.py', 'c.lat', 's.ax', 's.ay', 's.bx', 's.b_y')}) AS trace_distance_m
  FROM cls_u c JOIN seg s ON s.route_id = c.route_id GROUP BY c.ping_id),
cls1 AS (
  SELECT c.*, cd.trace_distance_m,
         CASE WHEN c.route_id IS NULL THEN 'route'
              WHEN c.route_id IN (SELECT route_id FROM traced) AND (cd.trace_distance_m IS NULL OR cd.trace_distance_m > {d(P.corridor_m)}) THEN 'corridor'
              WHEN NOT (c.lon > {d(W)} AND c.lon < {d(E)} AND c.lat > {d(S)} AND c.lat < {d(N)}) THEN 'envelope'
         END AS stateless_reason
  FROM cls0 c LEFT JOIN cdist cd ON cd.ping_id = c.ping_id),
att AS (
  SELECT ping_id, session_hash, ts, stateless_reason,
         row_number() OVER (PARTITION BY session_hash ORDER BY ts, ping_id) AS rn
  FROM cls1 WHERE payload_reason IS NULL),
fold(session_hash, rn, ping_id, last_acc, accepted, limited) AS (
  SELECT session_hash, rn, ping_id,
         CASE WHEN stateless_reason IS NULL THEN ts END,
         stateless_reason IS NULL, false
  FROM att WHERE rn = 1
  UNION ALL
  SELECT a.session_hash, a.rn, a.ping_id,
         CASE WHEN a.stateless_reason IS NULL AND (f.last_acc IS NULL OR a.ts >= f.last_acc + to_seconds({P.rate_limit_s}))
              THEN a.ts ELSE f.last_acc END,
         a.stateless_reason IS NULL AND (f.last_acc IS NULL OR a.ts >= f.last_acc + to_seconds({P.rate_limit_s})),
         f.last_acc IS NOT NULL AND a.ts < f.last_acc + to_seconds({P.rate_limit_s})
  FROM fold f JOIN att a ON a.session_hash = f.session_hash AND a.rn = f.rn + 1),
cls AS (
  SELECT c.ping_id, c.session_hash, c.code, c.route_id, c.lon, c.lat, c.ts, c.trace_distance_m,
         CASE WHEN c.payload_reason IS NOT NULL THEN c.payload_reason
              WHEN f.limited THEN 'rate'
              WHEN f.accepted THEN NULL
              ELSE c.stateless_reason END AS reject_reason
  FROM cls1 c LEFT JOIN fold f ON f.ping_id = c.ping_id),
pings_d AS (SELECT ping_id, session_hash, route_id, lon, lat, ts FROM cls WHERE reject_reason IS NULL)"""

LIVE = f"""
live_d AS (
  SELECT p.* FROM pings_d p
  WHERE p.ts >= {LIVE_LOWER} AND p.route_id IN (SELECT route_id FROM routes_d WHERE active))"""


def dbscan_sql(src: str, keys: list[str], prefix: str) -> str:
    """CTEs ``{prefix}_units`` and ``{prefix}_lab`` for min_points = 2 (pairs + closure)."""
    k_eq = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    keys_s = ", ".join(keys)
    eps2 = d(P.eps_m * P.eps_m)
    return f"""
{prefix}_u AS ({utm_sql(src, 'lon', 'lat', 'x', 'y')}),
{prefix}_pairs AS (
  SELECT a.ping_id AS a, b.ping_id AS b FROM {prefix}_u a JOIN {prefix}_u b
    ON {k_eq} AND a.ping_id < b.ping_id
  WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {eps2}),
{prefix}_e AS (SELECT a, b FROM {prefix}_pairs UNION ALL SELECT b AS a, a AS b FROM {prefix}_pairs),
{prefix}_reach(node, r) AS (
  SELECT a, a FROM {prefix}_e
  UNION
  SELECT q.node, e.b FROM {prefix}_reach q JOIN {prefix}_e e ON q.r = e.a),
{prefix}_comp AS (SELECT node AS ping_id, min(r) AS label FROM {prefix}_reach GROUP BY node),
{prefix}_lab AS (
  SELECT u.*, c.label FROM {prefix}_u u LEFT JOIN {prefix}_comp c ON c.ping_id = u.ping_id),
{prefix}_agg AS (
  SELECT {keys_s}, label, count(*) AS report_count, count(DISTINCT session_hash) AS session_count,
         max(ts) AS last_ts, avg(x) AS cx_m, avg(y) AS cy_m
  FROM {prefix}_lab WHERE label IS NOT NULL GROUP BY {keys_s}, label),
{prefix}_units AS (
  SELECT {keys_s}, CAST(dense_rank() OVER (PARTITION BY {keys_s} ORDER BY label) - 1 AS INTEGER) AS cluster_id,
         lon, lat, report_count, session_count, last_ts, label
  FROM ({lonlat_sql(f'{prefix}_agg', 'cx_m', 'cy_m', 'lon', 'lat')}))"""


def knn_sql(units: str, k: int) -> str:
    """Rows of ``units`` x their k nearest stops (degrees), with raw metres."""
    ranked = f"""(SELECT u.*, s.stop_id, s.name AS stop_name, s.seq AS stop_seq, s.lon AS stop_lon, s.lat AS stop_lat,
                row_number() OVER (PARTITION BY u.route_id, u.label
                                   ORDER BY {degdist_sql('u.lon', 'u.lat', 's.lon', 's.lat')}, s.seq, s.stop_id) AS stop_rank
         FROM {units} u JOIN stops_d s ON s.route_id = u.route_id)"""
    top = f"(SELECT * FROM {ranked} WHERE stop_rank <= {k})"
    a = utm_sql(top, "lon", "lat", "ux", "uy")
    b = utm_sql(f"({a})", "stop_lon", "stop_lat", "sx", "sy")
    return (f"SELECT *, {geodesic_sql('ux', 'uy', 'lat', 'sx', 'sy', 'stop_lat')} AS distance_raw_m "
            f"FROM ({b})")


def with_ctes(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(p.strip().rstrip(",") for p in parts)


R6 = lambda c: round_sql(c, 6)  # noqa: E731  coordinates compared at 1e-6 degree
