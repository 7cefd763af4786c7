import datetime as dt
import random

from pyspark.sql import functions as F

from pingpath.operators.ratelimit import decide, epoch_micros

T0 = dt.datetime(2026, 5, 1, 12, 0, 0)


def _run(spark, rows, window_s):
    data = [(s, i, T0 + dt.timedelta(seconds=t), p, v) for s, i, t, p, v in rows]
    df = spark.createDataFrame(data, "sid string, id long, ts timestamp_ntz, payload_ok boolean, valid boolean")
    narrow = df.withColumn("us", epoch_micros(df, "ts")).drop("ts")
    short = {r.id: (r.accepted, r.rate_limited) for r in decide(narrow, window_s).collect()}
    scaled = {r.id: (r.accepted, r.rate_limited) for r in decide(narrow, window_s, window_rows=0, local_nodes=0).collect()}
    assert short == scaled  # the ways for small and for large inputs agree
    return scaled


def fold(rows, window_s):
    """Plain sequential rule: rows = [(session, id, ts_seconds, payload_ok, valid)]."""
    out, last = {}, {}
    for s, i, t, pok, ok in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        limited = pok and s in last and last[s] > t - window_s
        out[i] = (pok and ok and not limited, limited)
        if out[i][0]:
            last[s] = t
    return out


def test_greedy_chain(spark):
    rows = [("s", i, t, True, True) for i, t in enumerate([0, 6, 12, 15, 22])]
    got = _run(spark, rows, 10)
    assert [i for i, (a, _) in sorted(got.items()) if a] == [0, 2, 4]


def test_edges(spark):
    rows = [("a", 1, 0, True, True), ("a", 2, 10, True, True),          # exactly W later: accepted
            ("b", 3, 0, True, False), ("b", 4, 3, True, True),          # rejected attempt holds no slot
            ("c", 5, 0, True, True), ("c", 6, 5, True, False),          # rate reason wins over others
            ("d", 7, 0, False, True), ("d", 8, 1, True, True)]          # payload failure holds no slot
    got = _run(spark, rows, 10)
    assert got == fold(rows, 10)
    assert got[2] == (True, False) and got[4] == (True, False) and got[6] == (False, True) and got[8] == (True, False)


def test_random_against_fold(spark):
    rnd = random.Random(7)
    rows, pid = [], 0
    for s in range(12):
        t = 0.0
        for _ in range(rnd.randint(1, 40)):
            t += rnd.choice([0.0, 0.5, 1.0, 2.5, 4.0, 9.9, 10.0, 11.0, 30.0])
            rows.append((f"s{s}", pid, t, rnd.random() > 0.1, rnd.random() > 0.2))
            pid += 1
    # one flooding session: an attempt every second for ten minutes
    for k in range(600):
        rows.append(("flood", pid, float(k), True, True))
        pid += 1
    assert _run(spark, rows, 10) == fold(rows, 10)


def test_gaps_across_every_level_of_the_time_tree(spark):
    """Instants microseconds, seconds, hours, weeks and years apart, and many at one instant."""
    rnd = random.Random(9)
    rows, t = [], 0.0
    for i in range(400):
        t += rnd.choice([0.0, 0.0, 1e-6, 0.4, 9.999999, 10.0, 999.0, 1000.0, 3600.0, 10**6, 3 * 10**6])
        rows.append((f"s{i % 3}", i, round(t, 6), True, rnd.random() > 0.3))
    assert _run(spark, rows, 10) == fold(rows, 10)


def test_no_window_holds_a_session_or_a_slot(spark):
    """One device floods: every window of the plan is keyed by a second or by a level of 1,000 children."""
    df = spark.range(2000).select(F.lit("one").alias("sid"), "id", (F.col("id") * 1000).alias("us"),
                                  F.lit(True).alias("payload_ok"), F.lit(True).alias("valid"))
    from pingpath.operators.ratelimit import LEVELS, neighbours
    plan = neighbours(df.select("sid", "us", F.lit(1).alias("kind"), "id"))._jdf.queryExecution().optimizedPlan().toString()
    keys = [line.split("], [")[1] if "], [" in line else line for line in plan.splitlines() if "Window [" in line]
    assert len(keys) >= 2 * (len(LEVELS) + 1)
    assert sum("b0#" in k and "b1#" in k for k in keys) >= 2
    assert sorted(r.id for r in decide(df, 10).where("accepted").collect()) == [0]
