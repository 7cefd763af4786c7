"""Grid DBSCAN against a brute-force O(n^2) DBSCAN on the same UTM coordinates."""
import datetime as dt
import math
import random

from pyspark.sql import functions as F

from pingpath.functions import geo
from pingpath.operators.cluster import cell_components, detect_units
from pingpath.operators.components import connected_components

T0 = dt.datetime(2026, 5, 1, 12, 0, 0)
M_LAT = 1 / 110700.0   # rough metres -> degrees, only to place test points
M_LON = 1 / 104200.0


def brute(points, eps, min_points):
    """points: [(id, key, x, y)] -> {id: frozenset(cluster member ids)} for clustered ids."""
    by_id = {p[0]: p for p in points}
    nb = {p[0]: [q[0] for q in points if q[1] == p[1] and (p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2 <= eps * eps]
          for p in points}
    core = {i for i, n in nb.items() if len(n) >= min_points}
    parent = {i: i for i in core}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i
    for i in core:
        for j in nb[i]:
            if j in core:
                a, b = find(i), find(j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
    label = {i: find(i) for i in core}
    for i in by_id:
        if i not in core:
            cands = [label[j] for j in nb[i] if j in core]
            if cands:
                label[i] = min(cands)
    groups = {}
    for i, l in label.items():
        groups.setdefault(l, set()).add(i)
    return {i: frozenset(groups[label[i]]) for i in label}


def _run(spark, rows, eps=20.0, min_points=2):
    df = spark.createDataFrame(
        [(i, f"s{i % 3}", k, lon, lat, T0) for i, k, lon, lat in rows],
        "ping_id long, session_hash string, route_id int, lon double, lat double, ts timestamp_ntz")
    units, labelled = detect_units(df, eps, min_points, ["route_id"])
    xy = geo.add_utm(df).select("ping_id", "route_id", "x", "y").collect()
    expect = brute([(r.ping_id, r.route_id, r.x, r.y) for r in xy], eps, min_points)
    got_rows = labelled.select("ping_id", "label").collect()
    groups = {}
    for r in got_rows:
        if r.label is not None:
            groups.setdefault(r.label, set()).add(r.ping_id)
    got = {i: frozenset(g) for g in groups.values() for i in g}
    return got, expect, units


def _cloud(rnd, n, lon0=-103.35, lat0=20.65, spread_m=150.0, key=1, start=0):
    return [(start + i, key, lon0 + rnd.uniform(-spread_m, spread_m) * M_LON,
             lat0 + rnd.uniform(-spread_m, spread_m) * M_LAT) for i in range(n)]


def test_random_clouds_match_brute_force(spark):
    rnd = random.Random(3)
    rows = _cloud(rnd, 120) + _cloud(rnd, 80, key=2, start=1000) + _cloud(rnd, 60, spread_m=40, start=2000)
    got, expect, _ = _run(spark, rows)
    assert got == expect


def test_general_min_points_matches_brute_force(spark):
    rnd = random.Random(5)
    rows = _cloud(rnd, 150, spread_m=120) + _cloud(rnd, 40, spread_m=25, start=500)
    got, expect, _ = _run(spark, rows, min_points=4)
    assert got == expect


def test_chain_dense_cell_duplicates_and_keys(spark):
    rows = [(i, 1, -103.35 + i * 15 * M_LON, 20.65) for i in range(15)]             # 15 m chain
    rows += [(100 + i, 1, -103.30, 20.70) for i in range(500)]                     # one position, 500 pings
    rows += [(1000 + i, 2, -103.35 + i * 15 * M_LON, 20.65) for i in range(3)]      # same points, other route
    got, expect, units = _run(spark, rows)
    assert got == expect
    assert len({got[i] for i in range(15)}) == 1 and len(got[0]) == 15
    counts = sorted(r.report_count for r in units.collect())
    assert counts == [3, 15, 500]


def test_eps_boundary(spark):
    got, expect, _ = _run(spark, [(1, 1, -103.35, 20.65), (2, 1, -103.35 + 19.9 * M_LON, 20.65),
                                  (3, 1, -103.30, 20.65), (4, 1, -103.30 + 20.5 * M_LON, 20.65)])
    assert got == expect
    assert 1 in got and 3 not in got


def test_permutation_invariance(spark):
    rnd = random.Random(11)
    rows = _cloud(rnd, 90, spread_m=80)
    a, _, _ = _run(spark, rows)
    ids = [r[0] for r in rows]
    rnd.shuffle(ids)
    remap = dict(zip([r[0] for r in rows], ids))
    b, _, _ = _run(spark, [(remap[i], k, lon, lat) for i, k, lon, lat in rows])
    inv = {v: k for k, v in remap.items()}
    assert {frozenset(g) for g in a.values()} == {frozenset(inv[i] for i in g) for g in b.values()}


def test_empty_input(spark):
    got, expect, units = _run(spark, [])
    assert got == {} and expect == {} and units.count() == 0


def test_components_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "src long, dst long")
    lab = {r.node: r.label for r in connected_components(edges, local_edges=0).collect()}
    assert set(lab[i] for i in range(201)) == {0} and lab[1001] == 1000


def test_components_of_a_node_with_two_lower_neighbours(spark):
    edges = spark.createDataFrame([(703, 727), (721, 727), (1, 9), (2, 9), (2, 8)], "src long, dst long")
    lab = {r.node: r.label for r in connected_components(edges, local_edges=0).collect()}
    assert lab == {703: 703, 721: 703, 727: 703, 1: 1, 2: 1, 8: 1, 9: 1}


def test_random_graphs_match_union_find(spark):
    rnd = random.Random(23)
    pairs = [(g * 100 + rnd.randrange(30), g * 100 + rnd.randrange(30)) for g in range(12) for _ in range(rnd.randrange(5, 45))]
    up = {}

    def find(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i
    for a, b in pairs:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    for limit in (0, 10_000):  # in rounds, and in one task
        graph = spark.createDataFrame(pairs, "src long, dst long")
        lab = {r.node: r.label for r in connected_components(graph, local_edges=limit).collect()}
        assert lab == {n: find(n) for a, b in pairs if a != b for n in (a, b)}


def test_dense_neighbour_cells_and_far_corners(spark):
    rnd = random.Random(17)
    # two dense blobs in neighbouring cells, and pairs of blobs at far corners of cells two apart
    rows = [(i, 1, -103.35 + rnd.uniform(0, 25) * M_LON, 20.65 + rnd.uniform(0, 12) * M_LAT) for i in range(400)]
    rows += [(1000 + i, 1, -103.30 + rnd.uniform(0, 0.5) * M_LON, 20.65 + rnd.uniform(0, 0.5) * M_LAT) for i in range(150)]
    rows += [(2000 + i, 1, -103.30 + (19.0 + rnd.uniform(0, 1.5)) * M_LON, 20.65 + rnd.uniform(0, 0.5) * M_LAT)
             for i in range(150)]
    got, expect, _ = _run(spark, rows)
    assert got == expect


def _core(spark, rows, eps):
    """Core positions (id, x, y) with their cells, as the clustering hands them over."""
    side = eps / math.sqrt(2)
    df = spark.createDataFrame(rows, "rep long, x double, y double").withColumn("route_id", F.lit(1))
    df = df.withColumn("cx", F.floor(F.col("x") / side)).withColumn("cy", F.floor(F.col("y") / side))
    reps = df.groupBy("cx", "cy").agg(F.min("rep").alias("cell_rep"))
    return df.join(reps, ["cx", "cy"]), side


def test_compared_pairs_do_not_grow_with_the_square(spark):
    """A dense 40 x 10 m strip: ten times the positions, not a hundred times the pairs."""
    work = {}
    for n in (10_000, 100_000):
        rnd = random.Random(n)
        core, side = _core(spark, [(i, 1000 + rnd.random() * 40, 2000 + rnd.random() * 10) for i in range(n)], 20.0)
        compared = []
        comp = cell_components(core, ["route_id"], side, 20.0, compared)
        assert {r.label for r in comp.collect()} == {0}
        work[n] = sum(compared)
    assert work[100_000] <= 12 * max(work[10_000], 10_000)


def test_two_dense_blobs_about_eps_apart(spark):
    """Finer boxes settle nearly all pairs; the answer is that of comparing all."""
    for gap in (19.95, 20.05):
        rnd = random.Random(5)
        a = [(1000 + rnd.random() * 3, 2000 + rnd.random() * 3) for _ in range(1500)]
        far = max(x for x, _ in a)
        b = [(far + gap + rnd.random() * 3, 2000 + rnd.random() * 3) for _ in range(1500)]
        core, side = _core(spark, [(i, x, y) for i, (x, y) in enumerate(a + b)], 20.0)
        compared = []
        labels = {r.node: r.label for r in cell_components(core, ["route_id"], side, 20.0, compared).collect()}
        nearest = min(math.dist(p, q) for p in a for q in b)
        groups = {labels.get(r.cell_rep, r.cell_rep) for r in core.select("cell_rep").distinct().collect()}
        assert len(groups) == (1 if nearest <= 20.0 else 2)
        assert sum(compared) < 0.1 * len(a) * len(b)
