"""Distance to the line where stops lie densely: the same distance from a list that does not grow."""
import random

import pytest
from pyspark.sql import functions as F

from pingpath.functions import geo
from pingpath.operators import corridor
from pingpath.operators.corridor import distance_to_trace, near_segments
from pingpath.operators.traces import segments
from pingpath.sources.tables import STOPS

CORRIDOR_M = 100.0


def _zigzag(spark, n):
    """Two routes of n stops over 2 km in a zigzag 200 m wide; one stop comes twice."""
    rows = [(r * n + i, r, "s", -103.35 + 0.0005 * r + 0.002 * (i % 2), 20.60 + 0.02 * i / n, i) for r in (1, 2) for i in range(n)]
    return spark.createDataFrame([*rows, rows[n // 2]], STOPS)


def _pings(spark, k):
    rng = random.Random(3)
    rows = [(i, rng.choice((1, 2, 3)), -103.35 + rng.uniform(-0.003, 0.005), 20.60 + rng.uniform(-0.003, 0.023)) for i in range(k)]
    rows += [(k, 1, None, 20.61), (k + 1, None, -103.35, 20.61), (k + 2, 1, -103.3495, 20.60), (k + 3, 1, -103.3495, 20.60)]
    return spark.createDataFrame(rows, "ping_id long, route_id int, lon double, lat double")


def _found(df):
    return {r.ping_id: (r.x, r.y, r.has_trace, r.trace_distance_m, r.beyond_corridor) for r in df.collect()}


@pytest.mark.parametrize("n", [40, 400])
def test_split_cells_find_the_same_distances(spark, n):
    stops, pings = _zigzag(spark, n), _pings(spark, 300)
    whole = _found(distance_to_trace(pings, stops, CORRIDOR_M, list_segs=10**6))
    assert len(whole) == 304
    for size in (1, 8, 32):
        assert _found(distance_to_trace(pings, stops, CORRIDOR_M, list_segs=size)) == whole
    p = geo.add_utm(pings, "lon", "lat", "x", "y").join(segments(stops).select("route_id", "ax", "ay", "bx", "by"), "route_id")
    d = geo.segment_grid_distance(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")) / geo.point_scale(F.col("x"), F.col("lat"))
    near = p.groupBy("ping_id").agg(F.min(d).alias("d")).where(f"d <= {CORRIDOR_M}").collect()
    assert near and all(whole[r.ping_id][3] == r.d and not whole[r.ping_id][4] for r in near)
    assert sum(1 for v in whole.values() if v[2] and not v[4]) == len(near)


def test_a_ping_measures_a_small_part_of_a_dense_cell(spark):
    pings, stops = _pings(spark, 300), _zigzag(spark, 4_000)
    split, whole = [near_segments(pings, stops, CORRIDOR_M, list_segs=size).agg(F.avg(F.size("segs"))).first()[0] for size in (32, 10**6)]
    assert 5 * split < whole


def test_lists_of_dense_cells_are_measured_by_several_tasks(spark, monkeypatch):
    """Few bytes, much to measure: neither the lists nor the pings that meet them come from one task."""
    files, materialise = {}, corridor.materialise

    def counted(df, name, *a):
        out = materialise(df, name, *a)
        files.setdefault(name, []).append(len(out.where("route_id IS NOT NULL").inputFiles()))
        return out

    monkeypatch.setattr(corridor, "materialise", counted)
    near_segments(_pings(spark, 300), _zigzag(spark, 4_000), CORRIDOR_M)
    assert min(files["corridor-lists"] + files["corridor-pings"]) >= 4
