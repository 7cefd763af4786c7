"""Month-partitioned store: the live window prunes partitions and pushes ts to Parquet."""
import datetime as dt

import fixtures as fx
import pytest

from pingpath.operators import dims, live
from pingpath.sources import rewrite
from pingpath.sources.tables import PINGS, read_pings, read_stops, write_pings, write_stops


def test_live_window_prunes_and_pushes_down(spark, tmp_path):
    rows = [(i, f"s{i}", 1, -103.35, 20.65, fx.AS_OF - dt.timedelta(days=40 * (i % 3), seconds=i))
            for i in range(30)]
    path = str(tmp_path / "pings")
    write_pings(spark.createDataFrame(rows, PINGS), path)
    stored = read_pings(spark, path)
    assert sorted(r.month for r in stored.select("month").distinct().collect()) == ["2026-02", "2026-03", "2026-05"]
    lp = live.live_pings(stored, fx.AS_OF, 120).select("ping_id", "ts")
    plan = lp._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,ping_id:bigint>" in plan or "ReadSchema: struct<ping_id:bigint,ts:timestamp_ntz>" in plan
    assert lp.count() == 10


def test_purge_deletes_expired_months_and_keeps_the_rest(spark, tmp_path):
    rows = [(i, f"s{i}", 1, -103.35, 20.65, fx.AS_OF - dt.timedelta(days=d, seconds=i))
            for i, d in enumerate([0, 0, 0.5, 0.9, 1, 1.0, 2, 30, 70, 100, 400])]
    path = str(tmp_path / "pings")
    write_pings(spark.createDataFrame(rows, PINGS), path)
    cut = fx.AS_OF - dt.timedelta(hours=24)
    report = live.purge_store(spark, path, fx.AS_OF, 24).first()
    want = sorted(r[0] for r in rows if r[5] >= cut)
    assert sorted(r.ping_id for r in read_pings(spark, path).collect()) == want
    assert report.purged == len(rows) - len(want)
    assert live.purge_store(spark, path, fx.AS_OF, 24).first().purged == 0
    assert sorted(r.ping_id for r in read_pings(spark, path).collect()) == want


def test_a_busy_route_month_has_several_files(spark, tmp_path):
    rows = spark.range(20_000).selectExpr("id AS ping_id", "'s' AS session_hash", "1 AS route_id", "-103.35D AS lon", "20.65D AS lat",
                                          "TIMESTAMP_NTZ'2026-05-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS ts")
    path = str(tmp_path / "busy")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_pings(rows, path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(list((tmp_path / "busy" / "month=2026-05").glob("*.parquet"))) > 1


def _rows():
    return [(i, f"{'demo_' if i % 4 == 0 else 's'}{i}", 1 + i % 3, -103.35, 20.65, fx.AS_OF - dt.timedelta(days=d, seconds=i))
            for i, d in enumerate([0, 0, 0.5, 0.9, 1, 1.0, 2, 3, 4, 5, 30, 70, 100, 400])]


def _files(path):
    return {str(f) for f in path.rglob("*.parquet")}


@pytest.mark.parametrize("step", ["write_pings", "_write_journal", "_move_in", "_remove", "finish"])
@pytest.mark.parametrize("after", [False, True])
@pytest.mark.parametrize("job", ["purge", "delete"])
def test_a_change_that_dies_loses_nothing_and_can_run_again(spark, tmp_path, monkeypatch, step, after, job):
    rows, path = _rows(), str(tmp_path / "pings")
    write_pings(spark.createDataFrame(rows, PINGS), path)
    cut = fx.AS_OF - dt.timedelta(hours=24)
    kept = [r[0] for r in rows if (r[5] >= cut if job == "purge" else not r[1].startswith("demo_"))]

    def run():
        return (live.purge_store(spark, path, fx.AS_OF, 24).first().purged if job == "purge"
                else live.delete_stored_sessions_like(spark, path, "demo_%"))

    real, calls = getattr(rewrite, step), []

    def dies(*args, **kw):
        calls.append(1)
        if step == "finish" and len(calls) == 1:  # the first call looks for an earlier change
            return real(*args, **kw)
        if after:
            real(*args, **kw)
        raise OSError("killed")

    with monkeypatch.context() as m:
        m.setattr(rewrite, step, dies)
        with pytest.raises(OSError):
            run()
    assert set(kept) <= {r.ping_id for r in read_pings(spark, path).collect()}
    run()
    assert sorted(r.ping_id for r in read_pings(spark, path).collect()) == kept
    assert run() == 0 and not (tmp_path / "pings" / "_change").exists()


def test_a_delete_rewrites_only_files_with_a_match(spark, tmp_path):
    path = tmp_path / "pings"
    write_pings(spark.createDataFrame([r for r in _rows() if not r[1].startswith("demo_")], PINGS), str(path))
    clean = _files(path)
    write_pings(spark.createDataFrame([r for r in _rows() if r[1].startswith("demo_") or r[0] == 1], PINGS), str(path))
    assert live.delete_stored_sessions_like(spark, str(path), "demo_%") == 4
    assert clean <= _files(path)
    left = sorted(r.ping_id for r in read_pings(spark, str(path)).collect())
    assert left == sorted([r[0] for r in _rows() if r[0] % 4] + [1])


def test_a_reload_rewrites_only_the_folders_of_its_routes(spark, tmp_path):
    path = tmp_path / "stops"
    stops, routes = fx.stops_df(spark), fx.routes_df(spark)
    write_stops(stops, str(path))
    before = _files(path)
    code = routes.where("active").select("code", "route_id").orderBy("code").first()
    new = spark.createDataFrame([(9_001, code.code, "new a", -103.3, 20.6, 1), (9_002, code.code, "new b", -103.31, 20.61, 2),
                                 (9_003, "none", "x", -103.3, 20.6, 1)], "stop_id long, code string, name string, lon double, lat double, seq int")
    report, unresolved = dims.reload_stored_stops(spark, str(path), routes, new)
    gone = {f for f in before if f"route_id={code.route_id}/" in f}
    assert gone and before - _files(path) == gone
    want = dims.replace_by_key(stops, dims.resolve_codes(new, routes)[0].select(*stops.columns), "route_id")
    key = lambda df: sorted(map(tuple, df.select("stop_id", "route_id", "name", "seq").collect()))
    assert key(read_stops(spark, str(path))) == key(want)
    assert {r.code: r.n_stops for r in report.collect()}[code.code] == 2 and [r.stop_id for r in unresolved.collect()] == [9_003]
