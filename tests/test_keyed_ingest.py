"""The keyed state decides attempts in order without history, and any order of arrival equals the batch."""
import datetime as dt
import random

import fixtures as fx
import pytest
from pyspark.sql import functions as F

from pingpath.config import Params
from pingpath.operators.ingest import classify
from pingpath.sources.tables import RAW_PINGS
from pingpath.streaming import keyed_ingest as ki
from pingpath.streaming import live_stream as ls

T0 = dt.datetime(2026, 5, 1, 12, 0, 0)
P = Params(salt="s")
JUAREZ = (-103.3547, 20.6747)


@pytest.fixture(autouse=True)
def few_state_stores(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def _raw(spark, rows, t0=T0):
    return spark.createDataFrame([(i, dev, code, lon, lat, None if s is None else t0 + dt.timedelta(seconds=s))
                                  for i, dev, code, lon, lat, s in rows], RAW_PINGS)


def _attempts():
    rng, rows = random.Random(5), []
    for dev in range(8):
        t = 0.0
        for _ in range(12):
            t += rng.choice([0, 3, 6, 9.5, 10, 14, 400])
            code = rng.choice(["L1", "L1", "L1", "ZZ"])
            lon = JUAREZ[0] if rng.random() < 0.85 else -103.32  # some beyond the corridor
            rows.append((len(rows), f"device-{dev}", code, lon, JUAREZ[1], t))
    rows.append((len(rows), "device-1", "L1", *JUAREZ, None))
    rows.append((len(rows), None, "L1", *JUAREZ, 7))
    return rows


def _run(spark, tmp_path, files, t0=T0, **more):
    src, root = str(tmp_path / "raw"), str(tmp_path / "store")
    undecided = []
    for rows in files:
        _raw(spark, rows, t0).coalesce(1).write.mode("append").parquet(src)
        _, second = ki.start(spark, ls.read_raw_stream(spark, src), root, fx.routes_df(spark), fx.stops_df(spark), P,
                             str(tmp_path / "progress"), trigger={"availableNow": True}, undecided=undecided, **more)
        second.awaitTermination(300)
    return root, undecided


def _batch(spark, rows, t0=T0):
    got = classify(_raw(spark, rows, t0), fx.routes_df(spark), fx.stops_df(spark), P)
    return {r.ping_id: r.reject_reason for r in got.collect()}


def _now(spark, root):
    return {r.ping_id: r.reject_reason for r in ls.current(spark, root).collect()}


def _in_order(rows):
    return sorted(rows, key=lambda r: (r[5] is None, r[5] or 0, r[0]))


def test_in_order_no_trigger_reads_history(spark, tmp_path, monkeypatch):
    rows = _in_order(_attempts())
    cut = next(k for k in range(50, 98) if rows[k][5] != rows[k - 1][5])  # equal instants arrive together
    want = _batch(spark, rows)
    monkeypatch.setattr(ki, "decided_again", lambda *a: pytest.fail("history read"))
    root, undecided = _run(spark, tmp_path, [rows[:cut], rows[cut:]])
    assert undecided == [0, 0] and _now(spark, root) == want
    assert {"rate", None} <= set(want.values())


def test_late_shuffled_and_repeated_files_equal_the_batch(spark, tmp_path):
    rows = _attempts()
    files = random.Random(3).sample(rows, len(rows))
    files = [files[i::2] for i in range(2)]
    root, undecided = _run(spark, tmp_path, files + [files[1][:20]])  # the last file is sent again
    assert _now(spark, root) == _batch(spark, rows) and undecided[1] > 0


def test_state_is_sure_again_after_a_pause(spark, tmp_path):
    def at(first, *secs):
        return [(first + k, "device-a", "L1", *JUAREZ, s) for k, s in enumerate(secs)]
    files = [at(0, 0, 12), at(10, 5, 13), at(20, 16, 18), at(30, 40, 45), at(40, 51)]
    root, undecided = _run(spark, tmp_path, files)
    assert undecided == [0, 2, 2, 0, 0] and _now(spark, root) == _batch(spark, sum(files, []))


def test_a_flooding_session_and_forgotten_state(spark, tmp_path):
    now = dt.datetime.now(dt.UTC).replace(tzinfo=None, microsecond=0) - dt.timedelta(minutes=30)
    flood = [(k, "device-a", "L1", *JUAREZ, k / 4) for k in range(60)]
    calm = [(100 + k, "device-b", "L1", *JUAREZ, 6 * k) for k in range(5)]
    old = [(200 + k, "device-c", "L1", *JUAREZ, -7_200 + 6 * k) for k in range(3)]  # older than the state lives
    root, undecided = _run(spark, tmp_path, [flood + calm + old], now, ttl=dt.timedelta(hours=1), trigger_rows=40)
    assert undecided == [63] and _now(spark, root) == _batch(spark, flood + calm + old, now)


def test_a_retried_trigger_stores_nothing_twice(spark, tmp_path):
    rows = _in_order(_attempts())
    root, _ = _run(spark, tmp_path, [rows])
    before = _now(spark, root)
    again = ls._versions(spark, f"{root}/classified", ls.CLASSIFIED).where("reject_reason IS NULL OR reject_reason = 'rate'")
    reason = F.col("reject_reason").isNull()
    ki.decided_body(spark, root, P)(again.select("ping_id", F.lit(0).cast("long").alias("arrival"), F.lit(True).alias("decided"),
                                                 reason.alias("accepted"), (~reason).alias("rate_limited")), 0)
    assert {i: r for i, r in _now(spark, root).items() if r in (None, "rate")} == {i: r for i, r in before.items() if r in (None, "rate")}
