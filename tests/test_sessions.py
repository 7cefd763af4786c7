"""Session sketches: unions of daily sketches against exact distinct counts."""
import datetime as dt

from pyspark.sql import functions as F

from pingpath.operators import sessions

PINGS = "session_hash string, route_id int, ts timestamp_ntz"


def exact(pings, *keys):
    return {tuple(r[:-1]): r[-1] for r in pings.groupBy(*keys).agg(F.countDistinct("session_hash")).collect()}


def test_unions_over_days_and_routes_are_close(spark):
    """Sessions return on other days and routes, so counts do not add up but unions hold."""
    n = F.col("id")
    pings = spark.range(200_000).select(
        F.sha2((n * 7919 % 60_000).cast("string"), 256).alias("session_hash"), (n % 3).cast("int").alias("route_id"),
        F.expr("timestamp_ntz'2025-03-01 00:00:00' + make_dt_interval(cast(id % 9 as int), 0, 0, 0)").alias("ts"))
    daily = sessions.daily_sketches(pings)
    assert daily.count() == 9
    days = pings.withColumn("day", F.to_date("ts"))
    for keys in (["route_id", "day"], ["route_id"], ["day"], []):
        got = {tuple(r[:-2]): r[-1] for r in sessions.distinct_sessions(sessions.merge(daily, *keys)).collect()}
        want = exact(days, *keys)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 0.03 * want[k] for k in want)
    assert exact(days)[()] == 60_000


def test_merging_in_steps_is_the_same(spark):
    rows = [(f"s{i % 700}", i % 4, dt.datetime(2025, 3, 1 + i % 5)) for i in range(3000)]
    daily = sessions.daily_sketches(spark.createDataFrame(rows, PINGS))
    once = sessions.distinct_sessions(sessions.merge(daily)).first()
    twice = sessions.distinct_sessions(sessions.merge(sessions.merge(daily, "route_id"))).first()
    assert (once.pings, once.sessions) == (twice.pings, twice.sessions) == (3000, 700)


def test_odd_rows(spark):
    day = dt.datetime(2025, 3, 1, 5)
    rows = [(None, 1, day), ("a", 1, day), ("a", 1, day), ("", 1, day), ("b", None, day), ("b", 2, None)]
    found = sessions.distinct_sessions(sessions.daily_sketches(spark.createDataFrame(rows, PINGS)))
    got = {(r.route_id, str(r.day)): (r.pings, r.sessions) for r in found.collect()}
    assert got[(1, "2025-03-01")][0] == 4 and got[(None, "2025-03-01")] == (1, 1) and got[(2, "None")] == (1, 1)
    none = sessions.daily_sketches(spark.createDataFrame([], PINGS))
    assert none.count() == 0 and sessions.merge(none, "route_id").count() == 0
