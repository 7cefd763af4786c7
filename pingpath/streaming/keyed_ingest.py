"""Streaming ingest with the rate limit's state kept by the engine, keyed by session (ST1, ST3).

Two queries, one behind the other:

1. ``arrivals_body``: the checks of single rows; the rows of a trigger go to ``arrived``,
   a folder a trigger.
2. ``session_decisions`` reads that folder as a stream and holds, per session, the newest
   instant seen and the instant last accepted (``transformWithState``, RocksDB).  Attempts
   newer than all before them are decided from that state; ``decided_body`` joins the
   decisions to the rows by id and stores both as ``live_stream`` does.  No stored history
   is read for them.

An attempt that is not newer than its session's state may change later decisions, which
the state does not hold.  The session's attempts of that trigger then come out undecided
and take ``live_stream.decided_again``, and so do its later ones until an attempt follows
after the whole wait: what went before cannot block it, so the state is sure again.
A session with more than ``TRIGGER_ROWS`` attempts in one trigger takes that way too, which
spreads them over tasks.  The decisions equal the batch job's for any order of arrival.

With ``ttl`` the engine forgets a session that long after its last attempt, by processing
time.  A session without state may then be a forgotten one, so an attempt that is not
newer than ``ttl`` less the wait counts as late.  This needs instants stamped on arrival,
as the service stamps them: none ahead of the clock.  Without ``ttl`` any instants will do and
state stays.

Null sessions or instants are refused by the payload check and meet no state.  An
attempt sent again (same id, same content) is the attempt stored before.  Empty triggers
store nothing; columns other than those of an attempt are ignored.
"""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pingpath.config import Params
from pingpath.operators.ingest import check, once, with_reason
from pingpath.operators.ratelimit import epoch_micros
from pingpath.session import materialise
from pingpath.sources.tables import RAW_PINGS
from pingpath.streaming.live_stream import CHECKED, CLASSIFIED, _exists, _put, _struct, _versions, decided_again

#: Attempts of one session in one trigger that a task decides in memory (26 bytes each).
TRIGGER_ROWS = 50_000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ARRIVED = T.StructType([*CHECKED.fields, T.StructField("arrival", T.LongType())])
DECISION = _struct(ping_id=T.LongType(), arrival=T.LongType(), decided=T.BooleanType(), accepted=T.BooleanType(),
                   rate_limited=T.BooleanType())
#: seen: newest instant; kept: instant last accepted (None: none yet); sure: the state knows what blocks.
STATE = _struct(seen=T.LongType(), kept=T.LongType(), sure=T.BooleanType())


def arrivals_body(root: str, routes: DataFrame, stops: DataFrame, params: Params,
                  salts: DataFrame | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch body of the first query: the checked attempts of a trigger in a folder of their own."""
    def body(batch: DataFrame, batch_id: int) -> None:
        rows = check(once(batch.select(*RAW_PINGS.fieldNames())), routes, stops, params, salts)
        (rows.select(*[F.col(f.name).cast(f.dataType) for f in CHECKED.fields])
         .write.mode("overwrite").parquet(f"{root}/arrived/arrival={batch_id}"))
    return body


def walk(us: np.ndarray, payload_ok: np.ndarray, valid: np.ndarray, kept: int | None,
         wait: int) -> tuple[np.ndarray, np.ndarray, int | None]:
    """(accepted, rate limited, instant last accepted) of attempts in order, after one accepted at ``kept``."""
    accepted, limited = np.zeros(len(us), bool), np.zeros(len(us), bool)
    for i in range(len(us)):
        if payload_ok[i]:
            if kept is not None and us[i] - kept < wait:
                limited[i] = True
            elif valid[i]:
                accepted[i], kept = True, int(us[i])
    return accepted, limited, kept


class SessionLimit(StatefulProcessor):
    """The rate limit of one session (key) over its attempts (ping_id, arrival, us, payload_ok, valid)."""

    def __init__(self, wait: int, ttl_us: int | None, trigger_rows: int = TRIGGER_ROWS):
        self.wait, self.ttl_us, self.trigger_rows = wait, ttl_us, trigger_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("limit", STATE, self.ttl_us // 1_000 if self.ttl_us else None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen, kept, sure = self.state.get() if self.state.exists() else (None, None, True)
        held, n, newest, whole = [], 0, seen, True
        for part in rows:
            if not len(part):
                continue
            newest = max(int(part["us"].max()), newest if newest is not None else int(part["us"].min()))
            n += len(part)
            held.append(part)
            if n > self.trigger_rows:  # too many for one task
                whole = False
                yield from map(_undecided, held)
                held = []
        if not whole:
            yield from map(_undecided, held)
            self.state.update((newest, None, False))
            return
        if not n:
            return
        p = pd.concat(held).sort_values(["us", "ping_id"]).drop_duplicates("ping_id", keep="first")
        us = p["us"].to_numpy()
        first = int(us[0])
        if seen is None:
            sure = self.ttl_us is None or first > time.time_ns() // 1_000 - self.ttl_us + self.wait
        elif first <= seen:
            sure = False
        elif not sure and first - seen >= self.wait:
            sure, kept = True, None
        if not sure:
            yield _undecided(p)
            self.state.update((newest, None, False))
            return
        accepted, limited, kept = walk(us, p["payload_ok"].to_numpy(), p["valid"].to_numpy(), kept, self.wait)
        yield pd.DataFrame({"ping_id": p["ping_id"], "arrival": p["arrival"], "decided": True,
                            "accepted": accepted, "rate_limited": limited})
        self.state.update((newest, kept, True))

    def close(self) -> None:
        pass


def _undecided(p: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"ping_id": p["ping_id"], "arrival": p["arrival"], "decided": False, "accepted": False,
                         "rate_limited": False})


def session_decisions(arrived: DataFrame, params: Params, ttl: dt.timedelta | None = None,
                      trigger_rows: int = TRIGGER_ROWS) -> DataFrame:
    """Decisions of a stream of ``ARRIVED`` rows; rows without a session or an instant come out decided, refused."""
    wait = int(round(params.rate_limit_s * 1_000_000))
    ttl_us = None if ttl is None else ttl // dt.timedelta(microseconds=1)
    keyed = F.col("session_hash").isNotNull() & F.col("ts").isNotNull()
    rows = arrived.where(keyed)
    narrow = rows.select(F.col("session_hash").alias("sid"), F.col("ping_id"), "arrival",
                         epoch_micros(rows, "ts").alias("us"),
                         F.col("payload_reason").isNull().alias("payload_ok"), F.col("stateless_reason").isNull().alias("valid"))
    limited = narrow.groupBy("sid").transformWithStateInPandas(
        SessionLimit(wait, ttl_us, trigger_rows), DECISION, "Append", "None" if ttl is None else "ProcessingTime")
    refused = arrived.where(~keyed).select("ping_id", "arrival", F.lit(True).alias("decided"), F.lit(False).alias("accepted"),
                                           F.lit(False).alias("rate_limited"))
    return limited.unionByName(refused)


def decided_body(spark: SparkSession, root: str, params: Params,
                 undecided: list[int] | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch body of the second query: store rows and decisions; ``undecided`` gets how many took the longer way."""
    def body(batch: DataFrame, batch_id: int) -> None:
        found = materialise(batch, "keyed-decisions")
        arrivals = [r["arrival"] for r in found.select("arrival").distinct().collect()]  # triggers of the first query
        if not arrivals:
            return
        rows = spark.read.schema(ARRIVED).parquet(f"{root}/arrived").where(F.col("arrival").isin(arrivals)).drop("arrival")
        _put(once(rows), f"{root}/checked", batch_id, CHECKED, "ts", "session_hash")
        new = _versions(spark, f"{root}/checked", CHECKED).where(F.col("batch") == batch_id)
        each = found.groupBy(F.col("ping_id").alias("id")).agg(
            F.min("decided").alias("decided"), F.max("accepted").alias("accepted"), F.max("rate_limited").alias("rate_limited"))
        sure = each.where("decided")
        settled = with_reason(new.join(sure.select(F.col("id").alias("ping_id")), "ping_id", "left_semi"), sure)
        late = each.where(~F.col("decided")).select(F.col("id").alias("ping_id"))
        n = late.count()
        if undecided is not None:
            undecided.append(n)
        columns = CLASSIFIED.fieldNames()
        out = settled.select(*columns)
        if n:
            again = decided_again(spark, root, materialise(new.join(late, "ping_id", "left_semi"), "late-rows"), batch_id, params)
            out = out.unionByName(again.select(*columns))
        _put(out, f"{root}/classified", batch_id, CLASSIFIED, "ts", "session_hash")

    return body


def start(spark: SparkSession, raw: DataFrame, root: str, routes: DataFrame, stops: DataFrame, params: Params,
          progress: str, salts: DataFrame | None = None, ttl: dt.timedelta | None = None, trigger: dict | None = None,
          max_files: int | None = None, undecided: list[int] | None = None,
          trigger_rows: int = TRIGGER_ROWS) -> tuple[StreamingQuery, StreamingQuery]:
    """Start both queries; ``trigger`` as of ``DataStreamWriter.trigger`` (an availableNow run ends the first before the second)."""
    trigger = trigger or {"processingTime": "5 seconds"}
    first = (raw.writeStream.foreachBatch(arrivals_body(root, routes, stops, params, salts))
             .option("checkpointLocation", f"{progress}/arrivals").trigger(**trigger).start())
    if trigger.get("availableNow"):
        first.awaitTermination()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/arrived")
    if not _exists(spark, f"{root}/arrived"):
        path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    source = spark.readStream.schema(ARRIVED)
    if max_files:
        source = source.option("maxFilesPerTrigger", max_files)
    found = session_decisions(source.parquet(f"{root}/arrived"), params, ttl, trigger_rows)
    # a query takes its settings when it starts; with ``ttl`` triggers without data, which forget
    # old state, would keep an availableNow run from ending
    settings = {"spark.sql.streaming.stateStore.providerClass": PROVIDER}
    if trigger.get("availableNow"):
        settings["spark.sql.streaming.noDataMicroBatches.enabled"] = "false"
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        second = (found.writeStream.foreachBatch(decided_body(spark, root, params, undecided))
                  .option("checkpointLocation", f"{progress}/decisions").trigger(**trigger).start())
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)
    return first, second
