"""Streaming ingest gives the batch answer whatever the order of arrival; counts and units by value."""
import datetime as dt
import pathlib
import random

import fixtures as fx
import pytest
from pyspark.sql import functions as F

from pingpath.config import Params
from pingpath.operators import cluster, live
from pingpath.operators.ingest import classify, once
from pingpath.session import ensure_checkpoint_dir
from pingpath.sources.tables import PINGS, RAW_PINGS, read_pings, write_pings
from pingpath.streaming import live_stream as ls

T0 = dt.datetime(2026, 5, 1, 12, 0, 0)
P = Params(salt="s")
JUAREZ = (-103.3547, 20.6747)


def _raw(spark, rows):
    return spark.createDataFrame([(i, dev, code, lon, lat, None if s is None else T0 + dt.timedelta(seconds=s))
                                  for i, dev, code, lon, lat, s in rows], RAW_PINGS)


def _attempts():
    rows, i = [], 0
    for dev, code, lon, lat, secs in [
        ("device-a", "L1", *JUAREZ, [0, 6, 12, 15, 22, 5_000, 5_001]),
        ("device-b", "L1", -103.32, 20.67, [0, 5_001]), ("device-b", "L1", -103.3550, 20.6667, [3, 14]),
        ("device-c", "C-09", -103.3997, 20.5747, [1, 2, 30]), ("dev", "L3", -103.3275, 20.66, [4]),
        ("device-d", "ZZ", -103.3275, 20.66, [5]), ("device-e", "L3", -103.3275, 20.66, [5, 16, None]),
        ("device-f", "L1", *JUAREZ, [300, 100, 303, 309, 311, 95]),
    ]:
        for s in secs:
            rows.append((i, dev, code, lon, lat, s))
            i += 1
    return rows


def _stream(spark, tmp_path, files, name="run"):
    """Write each list of rows as one file, in order, and run the stream one file at a time."""
    src, root = str(tmp_path / f"{name}-raw"), str(tmp_path / f"{name}-store")
    body = ls.ingest_body(spark, root, fx.routes_df(spark), fx.stops_df(spark), P)
    for k, rows in enumerate(files):
        _raw(spark, rows).coalesce(1).write.mode("append").parquet(src)
        q = (ls.read_raw_stream(spark, src, 1).writeStream.foreachBatch(body)
             .option("checkpointLocation", str(tmp_path / f"{name}-progress")).trigger(availableNow=True).start())
        q.awaitTermination(300)
        assert q.lastProgress is None or q.lastProgress["batchId"] >= k
    return root, body


def _batch(spark, rows):
    got = classify(_raw(spark, rows), fx.routes_df(spark), fx.stops_df(spark), P)
    return {r.ping_id: r.reject_reason for r in got.collect()}


def _now(spark, root):
    rows = ls.current(spark, root).collect()
    assert len(rows) == len({r.ping_id for r in rows})
    return {r.ping_id: r.reject_reason for r in rows}


@pytest.mark.parametrize("seed", [None, 1, 2])
def test_any_order_of_arrival_equals_the_batch(spark, tmp_path, seed):
    """Late rows (5,000 s behind), out-of-order rows, idle sessions that return, in several files."""
    rows = _attempts()
    want = _batch(spark, rows)
    shuffled = list(rows)
    if seed is None:
        shuffled.sort(key=lambda r: (r[5] is None, -(r[5] or 0)))  # newest first: every file is late
    else:
        random.Random(seed).shuffle(shuffled)
    root, _ = _stream(spark, tmp_path, [shuffled[i::3] for i in range(3)])
    assert _now(spark, root) == want
    stored = {i for i, reason in want.items() if reason is None}
    assert {r.ping_id for r in ls.stored_pings(spark, root).collect()} == stored
    assert {r.ping_id for r in ls.quarantine(spark, root).collect()} == set(want) - stored


def test_a_retried_batch_stores_nothing_twice(spark, tmp_path):
    rows = _attempts()
    root, body = _stream(spark, tmp_path, [rows[:12], rows[12:]])
    before = _now(spark, root)
    body(_raw(spark, rows[12:]), 1)  # the engine hands the last batch over again
    assert _now(spark, root) == before == _batch(spark, rows)
    ls.publish(spark, root, str(tmp_path / "store"))
    assert read_pings(spark, str(tmp_path / "store")).count() == sum(r is None for r in before.values())


def test_live_counts_by_value(spark, tmp_path):
    secs = [0, 10, 29, 30, 31, 119, 120, 500]
    rows = [(i, "s", 1 + i % 2, -103.35, 20.65, T0 + dt.timedelta(seconds=s)) for i, s in enumerate(secs)]
    store, root = str(tmp_path / "pings"), str(tmp_path / "counts")
    write_pings(spark.createDataFrame(rows, PINGS), store)
    counts = ls.live_counts(spark.readStream.schema(read_pings(spark, store).schema).parquet(store))
    q = (counts.writeStream.outputMode("update").foreachBatch(ls.counts_body(spark, root))
         .option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = {(r.s, r.route_id): r.pings for r in ls.current_counts(spark, root).select(
        F.unix_seconds("window_start").alias("s"), "route_id", "pings").collect()}
    base = int((T0 - dt.datetime(1970, 1, 1)).total_seconds())
    want = {}
    for i, s in enumerate(secs):
        for k in range(4):
            key = (base + s - s % 30 - 30 * k, 1 + i % 2)
            want[key] = want.get(key, 0) + 1
    assert got == want


def test_refreshed_units_equal_the_batch_and_the_clock_never_goes_back(spark, tmp_path):
    store, units = str(tmp_path / "pings"), str(tmp_path / "units")
    pings, routes = fx.demo_pings_df(spark), fx.routes_df(spark)
    write_pings(pings, store)
    body = ls.refresh_units(spark, store, routes, units, P)
    body(pings, 0)
    as_of = pings.agg(F.max("ts")).first()[0]
    want, _ = cluster.detect_units(live.live_pings(pings, as_of, P.live_window_s), P.eps_m, P.min_points, ["route_id"])
    key = lambda df: sorted((r.route_id, r.cluster_id, r.report_count, r.last_ts) for r in df.collect())
    assert key(ls.current_units(spark, units)) == key(want) and len(key(want)) >= 5
    body(pings.where("session_hash = 'demo_noise'"), 1)  # a late batch
    again = ls.current_units(spark, units)
    assert key(again) == key(want) and {r.as_of for r in again.collect()} == {as_of}


def test_attempts_sent_again_come_out_once_in_batch_and_stream(spark, tmp_path):
    rows = _attempts()
    again = rows[::3]
    got = classify(_raw(spark, rows + again), fx.routes_df(spark), fx.stops_df(spark), P).collect()
    want = _batch(spark, rows)
    assert len(got) == len(rows) and {r.ping_id: r.reject_reason for r in got} == want
    root, _ = _stream(spark, tmp_path, [rows[:12] + again[:2], rows[12:] + again, again])
    assert _now(spark, root) == want


def _hourly(n, step):
    return [(10 * k + j, f"device-{j:02d}", "L1", *JUAREZ, k * step + s) for k in range(n) for j, s in enumerate([0, 4, 700])]


def test_what_a_trigger_reads_does_not_grow(spark, tmp_path, monkeypatch):
    """Batches an hour apart: the stored rows that a trigger picks stay as many, however many are stored."""
    read, versions = [], ls._versions

    class Counted:
        def __init__(self, rows):
            self.rows = rows

        def where(self, condition):
            out = self.rows.where(condition)
            read[-1] += 0 if "batch" in str(condition) else out.count()
            return out

    def counted(spark, path, schema):
        return Counted(versions(spark, path, schema))

    root = str(tmp_path / "store")
    body = ls.ingest_body(spark, root, fx.routes_df(spark), fx.stops_df(spark), P)
    rows = _hourly(8, 3_600)
    with monkeypatch.context() as m:
        m.setattr(ls, "_versions", counted)
        for k in range(8):
            read.append(0)
            body(_raw(spark, rows[3 * k:3 * k + 3]), k)
    assert read[1:] == [read[1]] * 7 and 0 < read[1] <= 12
    assert _now(spark, root) == _batch(spark, rows)


def test_expiry_leaves_the_batch_answer_on_the_kept_range(spark, tmp_path):
    rows = _hourly(6, 3_600)
    root, body = _stream(spark, tmp_path, [rows[:9], rows[9:]])
    before = T0 + dt.timedelta(hours=3)
    assert ls.expire(spark, root, before, ("checked", "classified")) > 0
    kept = [r for r in rows if T0 + dt.timedelta(seconds=r[5]) >= before]
    want = {i: reason for i, reason in _batch(spark, rows).items() if i in {r[0] for r in kept}}
    assert _now(spark, root) == want == _batch(spark, kept)
    assert ls.expire(spark, root, before, ("checked", "classified")) == 0
    body(_raw(spark, rows[9:]), 1)  # a retry after expiry
    assert {i: r for i, r in _now(spark, root).items() if i in want} == want
    late = [(900, "device-00", "L1", *JUAREZ, 5 * 3_600 + 3)]
    body(_raw(spark, late), 2)
    assert {i: r for i, r in _now(spark, root).items() if i in want or i == 900} == _batch(spark, kept + late)


def test_old_snapshots_of_units_expire(spark, tmp_path):
    store, units = str(tmp_path / "pings"), str(tmp_path / "units")
    write_pings(fx.demo_pings_df(spark), store)
    body = ls.refresh_units(spark, store, fx.routes_df(spark), units, P)
    for k in range(3):
        body(fx.demo_pings_df(spark), k)
    want = ls.current_units(spark, units).count()
    assert ls.expire_units(spark, units, keep=1) == 2 and ls.current_units(spark, units).count() == want > 0


def test_sparse_rows_of_many_hours_are_not_a_file_each(spark, tmp_path):
    """One trigger over 40 hours of 16 sessions each: a file for an hour and a task, not for each session's class."""
    rows = [(100 * k + j, f"device-{j:02d}", "L1", *JUAREZ, k * 3_600 + j) for k in range(40) for j in range(16)]
    root, _ = _stream(spark, tmp_path, [rows])
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for table in ("checked", "classified"):
        assert len(list((tmp_path / "run-store" / table).rglob("*.parquet"))) <= 40 + tasks
    assert _now(spark, root) == _batch(spark, rows)


def test_a_trigger_checks_each_attempt_once_and_leaves_no_staged_table(spark, tmp_path, monkeypatch):
    """The check of a row is not run again for the ranges that stored rows lie in; what a trigger stages is gone after it."""
    checked, check = spark.sparkContext.accumulator(0), ls.check

    @F.udf("string")
    def counted(code):
        checked.add(1)
        return code

    folder, rows = pathlib.Path(ensure_checkpoint_dir(spark).removeprefix("file:")), _attempts()
    before, root = set(folder.iterdir()), str(tmp_path / "store")
    body = ls.ingest_body(spark, root, fx.routes_df(spark), fx.stops_df(spark), P)
    with monkeypatch.context() as m:
        m.setattr(ls, "check", lambda *a: check(*a).withColumn("code", counted("code")))
        body(_raw(spark, rows[::2]), 0)
        body(_raw(spark, rows[1::2]), 1)
    assert checked.value == len(rows)
    assert set(folder.iterdir()) == before
    assert _now(spark, root) == _batch(spark, rows)


def test_ids_that_come_again_with_other_rows_are_one_attempt_of_the_least(spark):
    """Equal copies, other rows under one id, and rows without an id, as ``once`` of all rows has them."""
    again = [(1, "device-a", "L1", *JUAREZ, 9), (1, "device-a", "L1", *JUAREZ, 3), (2, "device-b", "L1", *JUAREZ, 5),
             (2, "device-b", "L1", *JUAREZ, 5), (3, "device-c", None, *JUAREZ, None), (4, "device-d", "L1", *JUAREZ, 6)]
    df = _raw(spark, again).unionByName(_raw(spark, again[:2]).withColumn("ping_id", F.lit(None).cast("long")))
    assert sorted(map(str, ls._once_each(df).collect())) == sorted(map(str, once(df).collect()))
    assert sorted(map(str, ls._once_each(df.where("ping_id > 2")).collect())) == sorted(map(str, df.where("ping_id > 2").collect()))
