"""Units of the changed places only: equal to clustering the whole window after every trigger."""
import datetime as dt
import math
import random

import fixtures as fx
import pytest
from pyspark.sql import functions as F

from pingpath.config import Params
from pingpath.functions import geo
from pingpath.operators import cluster
from pingpath.sources.tables import PINGS
from pingpath.streaming import unit_refresh as ur

T0 = dt.datetime(2026, 5, 1, 12, 0, 0)
P = Params(salt="s")


def _pings(spark, rows):
    return spark.createDataFrame([(i, s, r, lon, lat, T0 + dt.timedelta(seconds=t)) for i, s, r, lon, lat, t in rows], PINGS)


def _walk(n, seed):
    """Vehicles that drive, park, meet and leave on three routes, one ping every five seconds or so, some late."""
    rng, rows = random.Random(seed), []
    for v in range(9):
        lon, lat = -103.35 + 0.0004 * (v % 4), 20.65 + 0.0003 * (v // 4)
        for k in range(n // 9):
            t = 5 * k + rng.random() * 4
            if v % 3:
                lon, lat = lon + rng.uniform(-1, 1.4) * 1e-4, lat + rng.uniform(-1, 1.2) * 1e-4
            rows.append((len(rows), f"s{v}", 1 + v % 3, lon, lat, t))
    rows.sort(key=lambda r: r[5] + (rng.choice([0, 0, 0, 60, 300])))  # order of arrival
    return rows


def _brute(rows, xy, min_points):
    """(route, cluster, pings, sessions) by comparing every two live pings."""
    newest = max(r[5] for r in rows)
    live = [r for r in rows if r[5] >= newest - P.live_window_s]
    near = {a[0]: [b[0] for b in live if a[2] == b[2] and math.dist(xy[a[0]], xy[b[0]]) <= P.eps_m] for a in live}
    core = {i for i, others in near.items() if len(others) >= min_points}
    label = {}
    for i in sorted(core):
        stack = [] if i in label else [i]
        while stack:
            j = stack.pop()
            if j not in label:
                label[j] = i
                stack += [k for k in near[j] if k in core]
    for i in set(near) - core:
        found = [label[j] for j in near[i] if j in core]
        if found:
            label[i] = min(found)
    by_id = {r[0]: r for r in live}
    out, seen = [], {}
    for root in sorted(set(label.values())):
        members = [by_id[i] for i, at in label.items() if at == root]
        route = members[0][2]
        out.append((route, seen.get(route, 0), len(members), len({m[1] for m in members}), root))
        seen[route] = seen.get(route, 0) + 1
    return sorted(out)


def _got(spark, root):
    return sorted((r.route_id, r.cluster_id, r.report_count, r.session_count, r.label) for r in ur.live_units(spark, root).collect())


@pytest.mark.parametrize("min_points,triggers", [(2, 20), (4, 3)])
def test_every_trigger_equals_the_whole_window(spark, tmp_path, min_points, triggers):
    rows = _walk(540, min_points)
    xy = {r.ping_id: (r.x, r.y) for r in geo.add_utm(_pings(spark, rows), "lon", "lat", "x", "y").collect()}
    params = Params(salt="s", min_points=min_points)
    counts, root = [], str(tmp_path / "units")
    body = ur.refresh_changed_units(spark, root, fx.routes_df(spark), params, counts)
    step = len(rows) // triggers
    for k in range(triggers):
        body(_pings(spark, rows[k * step:(k + 1) * step]), k)
        want = _brute(rows[:(k + 1) * step], xy, min_points)
        assert _got(spark, root) == want, k
        assert len(want) >= 1
    if triggers == 20:
        body(_pings(spark, rows[19 * step:20 * step]), 19)  # a retry
        assert _got(spark, root) == want
        body(_pings(spark, []), 20)  # nothing new
        assert _got(spark, root) == want
        assert ur.expire_window(spark, root, params, keep=1) > 0 and _got(spark, root) == want


def test_only_changed_places_are_clustered(spark, tmp_path):
    """Forty parked vehicles far apart: a trigger that moves one clusters one vehicle's pings."""
    def parked(v, first, t):
        return [(first + j, f"s{v}", 1, -103.40 + 0.002 * v, 20.65, t + j) for j in range(3)]
    rows = [r for v in range(40) for r in parked(v, 10 * v, 0)]
    counts, root = [], str(tmp_path / "units")
    body = ur.refresh_changed_units(spark, root, fx.routes_df(spark), P, counts)
    body(_pings(spark, rows), 0)
    body(_pings(spark, parked(7, 1_000, 30)), 1)
    assert counts == [120, 6]
    assert [u[2] for u in _got(spark, root)] == [6 if v == 7 else 3 for v in range(40)]
    body(_pings(spark, parked(7, 2_000, 125)), 2)  # the clock moves past all of the first pings
    assert _got(spark, root) == [(1, 0, 6, 1, 1_000)]


def test_centres_and_extra_columns(spark, tmp_path):
    pings, root = fx.demo_pings_df(spark), str(tmp_path / "units")
    want, _ = cluster.detect_units(pings, P.eps_m, P.min_points, ["route_id"])
    body = ur.refresh_changed_units(spark, root, fx.routes_df(spark), P)
    body(pings.where(F.lit(False)), 0)
    assert ur.live_units(spark, root).count() == 0
    odd = pings.withColumn("batch", F.lit("a")).withColumn("island", F.lit(1)).withColumn("cx", F.lit(1))
    body(odd.unionByName(odd.limit(1).withColumn("ts", F.lit(None).cast("timestamp_ntz"))), 1)
    key = lambda df: sorted((r.route_id, r.cluster_id, round(r.lon, 9), round(r.lat, 9), r.last_ts) for r in df.collect())
    assert key(ur.live_units(spark, root)) == key(want)
