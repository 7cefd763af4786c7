"""Small hand-checked inputs: the service's seed routes, stops and demo pings."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import SparkSession

from pingpath.sources.tables import PINGS, ROUTES, STOPS

AS_OF = dt.datetime(2026, 5, 1, 12, 0, 0)

# ---------------------------------------------------------------------------
# Seed routes (code, name, kind), initial stops per route in
# order (name, lon, lat), and the 18 demo pings (session, route code, lon, lat,
# seconds before as_of), as defined by the original service.
# ---------------------------------------------------------------------------
SEED_ROUTES = [
    ("L1", "Línea 1 Tren Ligero (Auditorio – Periférico Sur)", "tren_ligero"),
    ("L3", "Línea 3 Mi Tren (Arcos – Central Camionera)", "tren_ligero"),
    ("C-09", "Ruta C-09 (Centro Sur – Los Abedules)", "autobus"),
    ("A04", "Alimentadora A04 (Periférico Sur – Lomas San Agustín)", "alimentador"),
]
SEED_STOPS = {
    "L1": [
        ("Auditorio", -103.3494, 20.7381),
        ("Periférico Norte", -103.3497, 20.7306),
        ("Dermatológico", -103.3500, 20.7222),
        ("Atemajac", -103.3508, 20.7139),
        ("División del Norte", -103.3511, 20.7056),
        ("Ávila Camacho", -103.3514, 20.6972),
        ("Mezquitán", -103.3528, 20.6889),
        ("Refugio", -103.3539, 20.6806),
        ("Juárez", -103.3547, 20.6747),
        ("Mexicaltzingo", -103.3550, 20.6667),
        ("Washington", -103.3558, 20.6611),
        ("Santa Filomena", -103.3572, 20.6556),
        ("Unidad Deportiva", -103.3603, 20.6486),
        ("España", -103.3639, 20.6417),
        ("Urdaneta", -103.3681, 20.6361),
        ("18 de Marzo", -103.3722, 20.6306),
        ("Patria", -103.3778, 20.6222),
        ("Isla Raza", -103.3822, 20.6167),
        ("Santuario", -103.3883, 20.6111),
        ("Periférico Sur", -103.4011, 20.6067),
    ],
    "L3": [
        ("Central de Autobuses", -103.3175, 20.6550),
        ("Plaza de la Bandera", -103.3275, 20.6600),
        ("Ávila Camacho (Transbordo L1)", -103.3514, 20.6972),
        ("Normal", -103.3650, 20.6950),
        ("Arcos de Guadalajara", -103.3900, 20.6894),
    ],
    "C-09": [
        ("Centro Sur", -103.3997, 20.5747),
        ("Camino Real a Colima", -103.3933, 20.5694),
        ("Loma Bonita", -103.3867, 20.5639),
        ("El Vergel", -103.3800, 20.5583),
        ("Lomas del Valle", -103.3733, 20.5528),
        ("Los Abedules", -103.3667, 20.5472),
    ],
    "A04": [
        ("Periférico Sur (Conexión L1)", -103.4011, 20.6067),
        ("La Tijera", -103.4100, 20.5975),
        ("El Palomar", -103.4200, 20.5883),
        ("Los Gavilanes", -103.4280, 20.5800),
        ("Lomas de San Agustín", -103.4350, 20.5725),
    ],
}
DEMO_PINGS = [
    ("demo_a1", "L1", -103.3547, 20.6747, 30),
    ("demo_a2", "L1", -103.3548, 20.6748, 25),
    ("demo_a3", "L1", -103.3546, 20.6746, 18),
    ("demo_a4", "L1", -103.3547, 20.6749, 10),
    ("demo_b1", "L1", -103.3550, 20.6667, 45),
    ("demo_b2", "L1", -103.3551, 20.6668, 35),
    ("demo_b3", "L1", -103.3549, 20.6666, 20),
    ("demo_c1", "L1", -103.3514, 20.6972, 50),
    ("demo_c2", "L1", -103.3515, 20.6973, 40),
    ("demo_d1", "C-09", -103.3997, 20.5747, 20),
    ("demo_d2", "C-09", -103.3998, 20.5748, 15),
    ("demo_d3", "C-09", -103.3996, 20.5746, 8),
    ("demo_e1", "C-09", -103.3867, 20.5639, 30),
    ("demo_e2", "C-09", -103.3868, 20.5640, 22),
    ("demo_f1", "L3", -103.3275, 20.6600, 15),
    ("demo_f2", "L3", -103.3276, 20.6601, 10),
    ("demo_f3", "L3", -103.3274, 20.6599, 5),
    ("demo_noise", "L1", -103.3779, 20.6223, 55),
]
# ---------------------------------------------------------------------------

ROUTE_IDS = {code: i + 1 for i, (code, _, _) in enumerate(SEED_ROUTES)}


def routes_df(spark: SparkSession):
    rows = [(ROUTE_IDS[c], c, n, k, True) for c, n, k in SEED_ROUTES]
    return spark.createDataFrame(rows, ROUTES)


def stops_df(spark: SparkSession, stop_sets: dict | None = None):
    stop_sets = stop_sets or SEED_STOPS
    rows, sid = [], 1
    for code, stops in stop_sets.items():
        for seq, (name, lon, lat) in enumerate(stops, start=1):
            rows.append((sid, ROUTE_IDS[code], name, lon, lat, seq))
            sid += 1
    return spark.createDataFrame(rows, STOPS)


def demo_pings_df(spark: SparkSession, as_of: dt.datetime = AS_OF):
    rows = [(i, s, ROUTE_IDS[c], lon, lat, as_of - dt.timedelta(seconds=age))
            for i, (s, c, lon, lat, age) in enumerate(DEMO_PINGS, start=1)]
    return spark.createDataFrame(rows, PINGS)
