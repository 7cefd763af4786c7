"""Rate limit: at most one accepted ping per session every W seconds.

Rule of the service: an attempt is refused when the session already has a
*stored* ping with ts > attempt.ts - W.  Refused attempts hold no slot, so the
outcome is a greedy chain: after an accepted attempt at t the next accepted one
is the first valid attempt at or after t + W.  ``lag()`` is not enough (0, 6 and
12 s with W = 10 s accept 0 and 12), and folding one array per session would
put a flooding device's whole history into one task.

Exact and distributed instead, in bounded pieces:

* of the valid attempts of a session at one instant only the one of the least id
  can be accepted, so instants are pre-aggregated;
* "previous valid attempt" and "first valid attempt at or after ts + W" are looked
  up in a tree of time: seconds, 1,000 seconds, 11.6 days.  A window holds the
  instants of one second, the seconds of one 1,000 seconds, and so on, so none
  holds a session or a slot of W, however much one device id floods;
* an attempt whose previous valid attempt is at least W earlier (or that has
  none) starts a burst and is always accepted; inside a burst the accepted
  attempts are the chain start, next(start), next(next(start)), ...;
* that chain is expanded by pointer doubling: jump tables next^(2^k) are joined
  on attempt id (unique, so no hot key) until empty, then the starts are pushed
  through the tables from the longest jump down.  Pointers lead forward in time,
  so the tables run empty after log2 of the longest burst.

Small inputs take shorter ways to the same result: while no session has more than
``WINDOW_ROWS`` valid attempts, plain windows by session look up the neighbours, and
up to ``LOCAL_NODES`` pointers are followed by one task.

Only (session, id, instant, flags) takes part; rows meet the decision once, by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pingpath.session import materialise

#: Widths of the time tree's levels in microseconds; each holds 1,000 of the one before.
LEVELS = (10**6, 10**9, 10**12)
#: Valid attempts of one session that a window may hold, and pointers that a task may follow.
WINDOW_ROWS = 100_000
LOCAL_NODES = 500_000


def epoch_micros(df: DataFrame, col: str):
    """Microseconds since 1970-01-01 for TIMESTAMP or TIMESTAMP_NTZ columns."""
    if isinstance(df.schema[col].dataType, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{col}`)")
    return F.unix_micros(F.col(col))


def _around(rows: DataFrame, keys: list[str], order: list[str], first: str, last: str) -> DataFrame:
    """Adds ``before`` (greatest ``last`` of the rows before) and ``after`` (least ``first`` behind)."""
    up = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    down = (Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
            .rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("before", F.max(last).over(up)).withColumn("after", F.min(first).over(down))


def neighbours(points: DataFrame, tree: bool = True) -> DataFrame:
    """Adds ``before`` and ``after`` (struct us, id): the valid attempts next to each point.

    ``points`` has sid, us, kind (0 a query, 1 a valid attempt), id.  A query at an
    attempt's instant stands before it.
    """
    found = F.when(F.col("kind") == 1, F.struct("us", "id"))
    rows = points.withColumn("first", found).withColumn("last", found)
    if not tree:
        return _around(rows, ["sid"], ["us", "kind", "id"], "first", "last").drop("first", "last")
    bucket = [F.floor(F.col("us") / w).alias(f"b{i}") for i, w in enumerate(LEVELS)]
    rows = rows.select("*", *bucket)
    tables, keys = [], ["sid"] + [f"b{i}" for i in reversed(range(len(LEVELS)))]
    below = rows
    for i in range(len(LEVELS)):
        below = below.groupBy(*keys[:len(keys) - i]).agg(F.min("first").alias("first"), F.max("last").alias("last"))
        tables.append(below)
    above = None
    for i in reversed(range(len(LEVELS))):
        here = _around(tables[i], keys[:len(keys) - i - 1], [f"b{i}"], "first", "last").drop("first", "last")
        above = here if above is None else _inherit(here, above, keys[:len(keys) - i - 1])
    return _inherit(_around(rows, keys, ["us", "kind", "id"], "first", "last").drop("first", "last"), above, keys)


def _inherit(rows: DataFrame, above: DataFrame, keys: list[str]) -> DataFrame:
    """Where a row has no neighbour inside its bucket, the bucket's neighbour counts."""
    up = above.select(*keys, F.col("before").alias("_before"), F.col("after").alias("_after"))
    return (rows.join(up, keys).withColumn("before", F.coalesce("before", "_before"))
            .withColumn("after", F.coalesce("after", "_after")).drop("_before", "_after"))


def _follow(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ids reached from the starts along the pointers (id, next, start), starts included."""
    parts = [p for p in parts if len(p)]
    if not parts:
        return
    n = pd.concat(parts).sort_values("id")
    ids, start = n["id"].to_numpy(), n["start"].to_numpy()
    to = np.searchsorted(ids, n["next"].fillna(-1).to_numpy().astype(np.int64))
    to[n["next"].isna()] = -1
    reached = start.copy()
    front = np.flatnonzero(start)
    while len(front):
        front = to[front]
        front = front[front >= 0]
        front = np.unique(front[~reached[front]])
        reached[front] = True
    yield pd.DataFrame({"id": ids[reached]})


def _expand(nodes: DataFrame) -> DataFrame:
    """Ids reached from the starts, by pointer doubling."""
    starts = nodes.where("start").select("id")
    # next pointers inside a burst (a pointer to a burst start is dropped)
    jump = (nodes.where(F.col("next").isNotNull()).select("id", F.col("next").alias("to"))
            .join(starts.withColumnRenamed("id", "to"), "to", "left_anti").select("id", "to"))
    tables = []
    while True:
        jump = materialise(jump, "rate-jump")
        if jump.isEmpty():
            break
        tables.append(jump)
        jump = jump.join(jump.select(F.col("id").alias("to"), F.col("to").alias("to2")), "to").select(
            "id", F.col("to2").alias("to"))
    accepted = starts
    for table in reversed(tables):
        accepted = materialise(accepted.unionByName(
            accepted.join(table, "id").select(F.col("to").alias("id"))).distinct(), "rate-accepted")
    return accepted


def decide(attempts: DataFrame, window_s: float, window_rows: int = WINDOW_ROWS,
           local_nodes: int = LOCAL_NODES) -> DataFrame:
    """(id, accepted, rate_limited) of attempts (sid, id, us, payload_ok, valid).

    ``valid``: the attempt passes every check except the rate limit; ``payload_ok``:
    it passes the payload check, which runs before the rate limit.  Attempts without
    an instant or a session are neither accepted nor rate limited.
    """
    wait = int(round(window_s * 1_000_000))
    timed = attempts.where(F.col("us").isNotNull() & F.col("sid").isNotNull())
    v = (timed.where(F.col("valid") & F.col("payload_ok")).groupBy("sid", "us").agg(F.min("id").alias("id")))
    v = materialise(v, "rate-valid")
    points = v.select("sid", "us", F.lit(1).alias("kind"), "id").unionByName(
        v.select("sid", (F.col("us") + wait).alias("us"), F.lit(0).alias("kind"), "id"))
    size = v.groupBy("sid").count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
    near = neighbours(points, tree=(size["most"] or 0) > window_rows)
    nodes = near.groupBy("id").agg(
        F.max(F.when(F.col("kind") == 1, F.col("before")["us"])).alias("prev_us"),
        F.max(F.when(F.col("kind") == 1, F.col("us"))).alias("us"),
        F.max(F.when(F.col("kind") == 0, F.col("after")["id"])).alias("next"))
    nodes = nodes.select("id", "next", F.coalesce(F.col("us") - F.col("prev_us") >= wait, F.lit(True)).alias("start"))
    if (size["all"] or 0) <= local_nodes:
        accepted = nodes.coalesce(1).mapInPandas(_follow, "id long")
    else:
        accepted = _expand(materialise(nodes, "rate-nodes"))
    accepted = materialise(v.join(accepted, "id"), "rate-stored")

    # rate limited: an accepted attempt of the session, not after this one, less than W ago;
    # of the accepted attempts at most one lies in a slot of W
    slot = F.floor(F.col("us") / max(wait, 1))
    out = timed.select("id", "sid", "us", "payload_ok", slot.alias("slot"))
    blocked = F.lit(False)
    for back in (0, 1):
        a = accepted.select(F.col("sid").alias(f"s{back}"), (slot + back).alias(f"k{back}"),
                            F.col("us").alias(f"u{back}"), F.col("id").alias(f"i{back}"))
        out = out.join(a, (F.col("sid") == F.col(f"s{back}")) & (F.col("slot") == F.col(f"k{back}")), "left")
        u, i = F.col(f"u{back}"), F.col(f"i{back}")
        earlier = (u < F.col("us")) | ((u == F.col("us")) & (i < F.col("id")))
        blocked = blocked | F.coalesce(earlier & (u > F.col("us") - wait), F.lit(False))
    own = F.coalesce(F.col("i0") == F.col("id"), F.lit(False))
    return out.select("id", own.alias("accepted"), (F.col("payload_ok") & ~own & blocked).alias("rate_limited"))
