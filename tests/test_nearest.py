"""Nearest stops over places of very different density, against a full ranking."""
import glob
import math
import random

import pytest
from pyspark.sql import functions as F

from pingpath.operators import nearest
from pingpath.session import ensure_checkpoint_dir

STOPS = "stop_id long, route_id int, name string, lon double, lat double, seq int"
POINTS = "point long, route_id int, lon double, lat double"


def case(lat0=20.5):
    rnd = random.Random(9)
    rows = [(i, 1, f"d{i}", -103.4 + rnd.random() * 1e-4, lat0 + rnd.random() * 1e-4, i) for i in range(120)]  # a dense place
    rows += [(200 + i, 1, f"s{i}", -103.5 + rnd.random(), lat0 + rnd.random(), 200 + i) for i in range(40)]    # and sparse ones
    rows += [(300 + i, 2, "same", -103.1, lat0 + 0.1, 7) for i in range(9)]                                   # ties
    rows += [(400, 3, "one", -103.2, lat0, 1), (401, 3, "two", -103.3, lat0, 2), (402, 3, "nowhere", None, None, 3)]
    points = [(i, 1, -103.4 + rnd.random() * 1e-4, lat0 + rnd.random() * 1e-4) for i in range(30)]
    points += [(100 + i, i % 4, -103.6 + rnd.random() * 1.2, lat0 - 0.1 + rnd.random() * 1.2) for i in range(60)]
    points += [(300, 1, None, lat0), (301, 1, -60.0, lat0 + 5), (302, 2, -103.1, lat0 + 0.1)]
    return rows, points


def metres(a_lon, a_lat, s):
    """Great-circle metres: enough to rank stops that are not nearly as far."""
    p, q = math.radians(a_lat), math.radians(s[4])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(s[3] - a_lon) / 2) ** 2
    return 2 * 6_371_008.8 * math.asin(math.sqrt(h))


@pytest.mark.parametrize("k", [1, 3, 5])
def test_every_density_gives_the_full_ranking(spark, k):
    rows, points = case()
    got = {}
    for r in nearest.nearest_stops(spark.createDataFrame(points, POINTS), spark.createDataFrame(rows, STOPS), k).collect():
        got.setdefault(r.point, {})[r.stop_rank] = r.stop_id
    want = {}
    for i, route, lon, lat in points:
        ranked = sorted((math.sqrt((s[3] - lon) ** 2 + (s[4] - lat) ** 2), s[5], s[0])
                        for s in rows if s[1] == route and s[3] is not None) if lon is not None else []
        if ranked:
            want[i] = {n + 1: r[2] for n, r in enumerate(ranked[:k])}
    assert got == want and len(want) > 60


@pytest.mark.parametrize("lat0", [20.5, 70.0])
def test_metres_reach_far_enough_where_parallels_shrink(spark, lat0):
    rows, points = case(lat0)
    points = [p for p in points if p[2] is not None and p[2] < -100]
    found = nearest.nearest_stops(spark.createDataFrame(points, POINTS), spark.createDataFrame(rows, STOPS), 3, "metres").collect()
    at = {p[0]: p for p in points}
    worst = {}
    for r in found:
        p = at[r.point]
        worst[r.point] = max(worst.get(r.point, 0), metres(p[2], p[3], next(s for s in rows if s[0] == r.stop_id)))
    for i, route, lon, lat in points:
        ranked = sorted(metres(lon, lat, s) for s in rows if s[1] == route and s[3] is not None)
        if ranked:  # the ellipsoid and the sphere differ by less than 0.6 %
            assert worst[i] <= ranked[:3][-1] * 1.012 + 0.01


def test_one_table_is_written_and_dense_places_compare_few(spark):
    rows, points = case()
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{folder}/nearest-*"))
    pts, stops = spark.createDataFrame(points, POINTS), spark.createDataFrame(rows, STOPS)
    assert nearest.nearest_stops(pts, stops, 3).count() > 0
    assert len(set(glob.glob(f"{folder}/nearest-*")) - before) == 1
    side, top = nearest.ladder(pts, stops)
    located = stops.where("lon is not null").withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(top))))
    cells = (located.withColumn("_gx", nearest._cell("lon", side, F.col("_level")))
             .withColumn("_gy", nearest._cell("lat", side, F.col("_level"))))
    start = nearest.start_levels(pts.where("lon is not null").withColumnRenamed("point", "_row"), cells, side, top, 3)
    levels = {r._row: r._start for r in start.collect()}
    assert max(levels[i] for i in range(30)) < min(levels[i] for i in range(100, 160) if i % 4 == 1)


def test_empty_sides(spark):
    rows, points = case()
    pts, stops = spark.createDataFrame(points, POINTS), spark.createDataFrame(rows, STOPS)
    assert nearest.nearest_stops(pts.limit(0), stops).count() == 0
    assert nearest.nearest_stops(pts, stops.limit(0)).count() == 0
