"""Validation order and boundary cases of the ingest job (FIXTURES.md §4)."""
import datetime as dt

import fixtures as fx
import pytest
from pyspark.sql import functions as F

from pingpath.config import Params
from pingpath.operators.ingest import classify, ingest
from pingpath.sources.tables import RAW_PINGS, ROUTES

T0 = dt.datetime(2026, 5, 1, 12, 0, 0)
OK = "device-0001"


def _routes(spark):
    extra = [(5, "X1", "sin trazado", "autobus", True), (6, "OFF", "inactiva", "autobus", False)]
    return fx.routes_df(spark).unionByName(spark.createDataFrame(extra, ROUTES))


SALTED = Params(salt="s")


def _reasons(spark, rows, params=SALTED):
    raw = spark.createDataFrame(
        [(i, u, c, lon, lat, None if s is None else T0 + dt.timedelta(seconds=s)) for i, (u, c, lon, lat, s) in enumerate(rows)], RAW_PINGS)
    out = classify(raw, _routes(spark), fx.stops_df(spark), params)
    return [r.reject_reason for r in out.orderBy("ping_id").collect()]


def test_payload_and_route_checks(spark):
    rows = [
        ("d" * 7, "L1", -103.3547, 20.6747, 0), ("d" * 8, "L1", -103.3547, 20.6747, 100),
        ("e" * 64, "L1", -103.3547, 20.6747, 200), ("f" * 65, "L1", -103.3547, 20.6747, 300),
        ("g" * 10, "", -103.3547, 20.6747, 0), ("h" * 10, "ABCDEFGHIJK", -103.3547, 20.6747, 0),
        ("i" * 10, "L1", -103.40, 19.0, 0),              # out of area
        ("j" * 10, "L1", -103.32, 20.67, 0),             # 3.6 km from L1
        ("k" * 10, "ZZ", -103.3547, 20.6747, 0), ("l" * 10, "OFF", -103.3547, 20.6747, 0),
        ("m" * 10, "X1", -103.30, 20.40, 0),             # on the bound: payload ok, envelope strict
        ("n" * 10, "X1", -103.30, 20.50, 0),             # route without trace accepts anywhere
    ]
    assert _reasons(spark, rows) == [
        "payload_uuid", None, None, "payload_uuid", "payload_code", "payload_code", "payload_bounds",
        "corridor", "route", "route", "envelope", None]


def test_rate_limit_order(spark):
    p = (-103.3547, 20.6747)
    rows = [(OK, "L1", *p, t) for t in (0, 6, 12, 15, 22)]
    assert _reasons(spark, rows) == [None, "rate", None, "rate", None]
    rows = [("u" * 9, "L1", *p, 0), ("u" * 9, "L1", *p, 10)]
    assert _reasons(spark, rows) == [None, None]
    rows = [("v" * 9, "L1", *p, 0), ("v" * 9, "L3", -103.3275, 20.66, 5)]        # across routes
    assert _reasons(spark, rows) == [None, "rate"]
    rows = [("w" * 9, "L1", -103.32, 20.67, 0), ("w" * 9, "L1", *p, 3)]         # refused ping holds no slot
    assert _reasons(spark, rows) == ["corridor", None]
    rows = [("x" * 9, "L1", *p, 0), ("x" * 9, "ZZ", *p, 4)]                      # rate checked before route
    assert _reasons(spark, rows) == [None, "rate"]


def test_a_row_without_an_instant_changes_nothing(spark):
    p = (-103.3547, 20.6747)
    rows = [(OK, "L1", *p, None), (OK, "L1", *p, 0), (OK, "L1", *p, 3), (OK, "L1", *p, 6), (OK, "L1", *p, None), (OK, "L1", *p, 11)]
    assert _reasons(spark, rows) == ["payload_ts", None, "rate", "rate", "payload_ts", None]


def test_salt_is_required_and_a_day_without_one_is_refused(spark):
    raw = spark.createDataFrame([(1, OK, "L1", -103.3547, 20.6747, T0), (2, OK, "L1", -103.3547, 20.6747, T0 + dt.timedelta(days=1))], RAW_PINGS)
    with pytest.raises(ValueError):
        classify(raw, _routes(spark), fx.stops_df(spark), Params())
    salts = spark.createDataFrame([(T0.date(), "monday")], "day date, salt string")
    got = {r.ping_id: r for r in classify(raw, _routes(spark), fx.stops_df(spark), Params(), salts).collect()}
    import hashlib
    assert got[1].session_hash == hashlib.sha256(f"{OK}:monday".encode()).hexdigest() and got[1].reject_reason is None
    assert got[2].session_hash is None and got[2].reject_reason == "payload_salt"


def test_hash_and_outputs(spark):
    raw = spark.createDataFrame([(1, OK, "L1", -103.3547, 20.6747, T0), (2, "other-device", "ZZ", -103.3547, 20.6747, T0)], RAW_PINGS)
    acc, rej = ingest(raw, _routes(spark), fx.stops_df(spark), Params(salt="s"))
    import hashlib
    h = hashlib.sha256(f"{OK}:s".encode()).hexdigest()
    assert [(r.ping_id, r.session_hash, r.route_id) for r in acc.collect()] == [(1, h, 1)]
    assert [(r.ping_id, r.reject_reason) for r in rej.collect()] == [(2, "route")]
    assert "uuid" not in acc.columns and "uuid" not in rej.columns
