"""Structured Streaming twins of the batch jobs (ST1-ST5).

* ``ingest_body`` (ST1, ST3, ST4): a ``foreachBatch`` body that gives the batch
  job's answer whatever the order of arrival.  The state of the rate limit is the
  stored decisions themselves.  A decision depends only on earlier attempts of its
  session, so a new attempt at t changes decisions from t on at most: the body
  decides the new attempts again together with the stored attempts of the same
  sessions from their earliest new instant on, seeded with the last accepted ping
  before it.  In order, that is the new rows alone; a late row brings its session's
  later attempts back.  Nothing is dropped for being late, and no watermark, timeout
  or in-memory state is involved.
* Stored rows lie by hour, a folder each, and by class of session in its files, and a
  trigger picks only the classes it has sessions of, from its earliest hour there on: in
  order that is the running hour, however long the stream has run.  A late row brings back
  the hours since.  A trigger writes about a file for each hour and task, so sparse rows of
  many hours do not become a file each, and the rows of one busy hour come from many tasks.
  Its checks run once a row, and the tables that it stages are removed at its end.
* Each trigger writes its rows under its batch id, replacing what an earlier try of
  the same batch left, so a retried batch stores nothing twice.  A row decided again
  has a newer version; ``current`` takes the newest of each ping.  An attempt sent again
  is the attempt stored before.
* ``live_counts`` (ST2): pings per route in 2-minute windows sliding by 30 s, with a
  watermark; rows later than it leave these counts only.  ``counts_body`` keeps the
  newest count of each window, by batch id too.
* ``refresh_units`` (ST2): a ``foreachBatch`` body that clusters the live window of the
  stored pings again into a new snapshot.  Its clock is the newest instant seen so
  far, so a late batch does not turn it back.
* Expiry (ST5): ``expire`` removes whole hours of the stream's own tables, ``expire_units``
  old snapshots; ``operators.live.purge_store`` purges the published store.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pingpath.config import Params
from pingpath.operators import cluster, live
from pingpath.operators.ingest import accepted_rows, attempts_of, check, once, rejected_rows, with_reason
from pingpath.operators.ratelimit import decide, epoch_micros
from pingpath.session import materialise, staged
from pingpath.sources.tables import RAW_PINGS, read_pings, write_pings

#: Classes of sessions by hash, and the hours, that stored attempts lie in.
CLASSES = 16
HOUR_US = 3_600_000_000


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_ROW = {"ping_id": T.LongType(), "session_hash": T.StringType(), "code": T.StringType(), "route_id": T.IntegerType(),
        "lon": T.DoubleType(), "lat": T.DoubleType(), "x": T.DoubleType(), "y": T.DoubleType(),
        "ts": T.TimestampNTZType(), "trace_distance_m": T.DoubleType()}
CHECKED = _struct(**_ROW, payload_reason=T.StringType(), stateless_reason=T.StringType())
CLASSIFIED = _struct(**_ROW, reject_reason=T.StringType())
COUNTS = _struct(window_start=T.TimestampType(), window_end=T.TimestampType(), route_id=T.IntegerType(), pings=T.LongType())


def read_raw_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(RAW_PINGS)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _versions(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows under ``path`` with the batch that wrote them; none if nothing was written yet."""
    full = T.StructType([*schema.fields, T.StructField("class", T.IntegerType()), T.StructField("hour", T.LongType()),
                         T.StructField("batch", T.LongType())])
    if not _exists(spark, path):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).parquet(path)


def _hour(rows: DataFrame, instant: str) -> Column:
    return F.floor(epoch_micros(rows, instant) / HOUR_US)


def _placed(rows: DataFrame, batch_id: int, schema: T.StructType, instant: str, owner: str) -> DataFrame:
    """The rows of one batch with the class of owner, hour and batch that they are stored under."""
    kept = rows.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
    return (kept.withColumn("class", F.pmod(F.xxhash64(owner), F.lit(CLASSES)).cast("int")).withColumn("hour", _hour(kept, instant))
            .withColumn("batch", F.lit(batch_id).cast("long")))


def _put(rows: DataFrame, path: str, batch_id: int, schema: T.StructType, instant: str, owner: str) -> None:
    """Write the rows of one batch, by hour and class of owner, in the place of an earlier try.

    Ranges are found from a sample, so ``rows`` is computed twice: what is dear is written once before.
    """
    # a number given is not brought down for small rows: it is files, not bytes, that the tasks share
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (_placed(rows, batch_id, schema, instant, owner).repartitionByRange(tasks, "hour", "class", instant)
     .sortWithinPartitions("hour", "batch", "class")  # the order lets scans skip the classes they do not ask for
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("hour", "batch").parquet(path))


def _touched(rows: DataFrame, hours_before: int = 0) -> tuple[Column, Column]:
    """The classes, and from which hour on, that can hold what ``rows`` meet; the same from ``hours_before`` earlier on."""
    since = (rows.where(F.col("hour").isNotNull() & F.col("session_hash").isNotNull())
             .groupBy("class").agg(F.min("hour").alias("hour")).collect())  # at most CLASSES rows

    def found(before: int) -> Column:
        return reduce(or_, [(F.col("class") == r["class"]) & (F.col("hour") >= r["hour"] - before) for r in since], F.lit(False))
    return found(0), found(hours_before)


def _once_each(rows: DataFrame) -> DataFrame:
    """``once`` of written rows where few ids come twice: only those are sorted, the others stay where they are."""
    twice = materialise(rows.groupBy("ping_id").count().where("count > 1").select(F.col("ping_id").alias("_twice")), "stream-twice")
    if twice.isEmpty():
        return rows
    same = rows["ping_id"].eqNullSafe(F.col("_twice"))
    return rows.join(twice, same, "left_anti").unionByName(once(rows.join(twice, same, "left_semi")))


def _newest(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    # versions of one key lie in different files: sorting each file's rows before the exchange would bring none together
    latest = rows.repartition(*keys).groupBy(*keys).agg(F.max_by(F.struct(*[c for c in columns if c not in keys]), "batch").alias("_v"))
    return latest.select(*[F.col(c) if c in keys else F.col(f"_v.{c}").alias(c) for c in columns])


def current(spark: SparkSession, root: str) -> DataFrame:
    """Every attempt stored so far with its newest decision (reject_reason NULL = accepted)."""
    return _newest(_versions(spark, f"{root}/classified", CLASSIFIED), ["ping_id"], CLASSIFIED.fieldNames())


def stored_pings(spark: SparkSession, root: str) -> DataFrame:
    return accepted_rows(current(spark, root))


def quarantine(spark: SparkSession, root: str) -> DataFrame:
    return rejected_rows(current(spark, root))


def publish(spark: SparkSession, root: str, path: str) -> None:
    """Write the accepted pings as a month-partitioned store for the batch jobs."""
    write_pings(stored_pings(spark, root), path, mode="overwrite")


def _seeds(before: DataFrame, since: DataFrame, wait: int) -> DataFrame:
    """The accepted pings (sid, id, us, payload_ok, valid) less than ``wait`` before the session's instant in ``since``.

    Only attempts with a version that could be one are brought to their newest version.
    """
    narrow = before.select("ping_id", "session_hash", "ts", "reject_reason", "batch")

    def accepted(rows: DataFrame) -> DataFrame:
        at = epoch_micros(rows, "ts")
        kept = rows.where(F.col("reject_reason").isNull())
        return (kept.join(since, (kept["session_hash"] == F.col("_s")) & (at < F.col("_from")) & (at > F.col("_from") - wait))
                .select(F.col("session_hash").alias("sid"), F.col("ping_id").alias("id"), at.alias("us"),
                        F.lit(True).alias("payload_ok"), F.lit(True).alias("valid")))

    maybe = materialise(accepted(narrow).select(F.col("id").alias("_id")).distinct(), "stream-maybe")
    versions = narrow.join(maybe, narrow["ping_id"].eqNullSafe(F.col("_id")), "left_semi")
    return accepted(_newest(versions, ["ping_id"], ["ping_id", "session_hash", "ts", "reject_reason"]))


def decided_again(spark: SparkSession, root: str, new: DataFrame, batch_id: int, params: Params) -> DataFrame:
    """The stored rows ``new`` of a batch and the older rows whose decision they can change, with their decisions."""
    wait = int(round(params.rate_limit_s * 1_000_000))
    stored = _versions(spark, f"{root}/checked", CHECKED)
    touched, earlier = _touched(new, -(-wait // HOUR_US))
    older = stored.where(touched).where(F.col("batch") < batch_id)
    before = _versions(spark, f"{root}/classified", CLASSIFIED).where(earlier).where(F.col("batch") < batch_id)
    us = epoch_micros(new, "ts")
    since = materialise(new.where(F.col("ts").isNotNull() & F.col("session_hash").isNotNull())
                        .groupBy(F.col("session_hash").alias("_s")).agg(F.min(us).alias("_from")), "stream-since")
    again = older.join(since, (older["session_hash"] == F.col("_s")) & (epoch_micros(older, "ts") >= F.col("_from"))).drop("_s", "_from")
    rows = _once_each(materialise(new.unionByName(again).drop("batch", "class", "hour"), "stream-rows"))
    attempts = materialise(attempts_of(rows).unionByName(_seeds(before, since, wait)), "stream-attempts")
    decisions = materialise(decide(attempts, params.rate_limit_s), "stream-decisions")
    return with_reason(rows, decisions)


def ingest_body(spark: SparkSession, root: str, routes: DataFrame, stops: DataFrame, params: Params,
                salts: DataFrame | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch body: store the attempts of a batch and every decision it changes."""
    def body(batch: DataFrame, batch_id: int) -> None:
        with staged(spark):
            new = materialise(_placed(check(once(batch), routes, stops, params, salts), batch_id, CHECKED, "ts", "session_hash"), "stream-new")
            _put(new, f"{root}/checked", batch_id, CHECKED, "ts", "session_hash")
            decided = materialise(decided_again(spark, root, new, batch_id, params), "stream-decided")
            _put(decided, f"{root}/classified", batch_id, CLASSIFIED, "ts", "session_hash")

    return body


def expire(spark: SparkSession, root: str, before: dt.datetime, tables: tuple[str, ...] = ("checked", "classified", "counts")) -> int:
    """Remove the stored hours that end at or before ``before`` (ST5); returns the number of folders removed.

    An hour is a folder, so no row is read.  What stays answers as the batch
    job on the kept range does.  ``before`` has to lie the rate limit's wait and the longest
    lateness behind the stream's clock: a row that comes for an hour already gone is
    decided without it.
    """
    limit, gone = (before - dt.datetime(1970, 1, 1)) // dt.timedelta(hours=1), 0
    for table in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{table}")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        for hour in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{table}/hour=*")) or []:
            name = hour.getPath().getName()
            if name[5:].lstrip("-").isdigit() and int(name[5:]) < limit:
                fs.delete(hour.getPath(), True)
                gone += 1
    return gone


def expire_units(spark: SparkSession, units_path: str, keep: int = 2) -> int:
    """Remove all but the newest ``keep`` snapshots of the units (ST5); returns how many went."""
    path = spark._jvm.org.apache.hadoop.fs.Path(units_path)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted((int(s.getPath().getName()[6:]), s.getPath()) for s in fs.listStatus(path) if s.getPath().getName().startswith("batch="))
    for _, snapshot in found[:-keep]:
        fs.delete(snapshot, True)
    return len(found[:-keep])


def live_counts(pings: DataFrame, window: str = "2 minutes", slide: str = "30 seconds",
                watermark: str = "2 minutes") -> DataFrame:
    """Pings per route per sliding window (ST2); event time must be TIMESTAMP."""
    p = pings.withColumn("ts", F.col("ts").cast("timestamp"))
    return (p.withWatermark("ts", watermark)
            .groupBy(F.window("ts", window, slide), "route_id")
            .agg(F.count(F.lit(1)).alias("pings"))
            .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                    "route_id", "pings"))


def counts_body(spark: SparkSession, root: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch body for ``live_counts`` in update mode."""
    def body(batch: DataFrame, batch_id: int) -> None:
        _put(batch, f"{root}/counts", batch_id, COUNTS, "window_start", "route_id")
    return body


def current_counts(spark: SparkSession, root: str) -> DataFrame:
    return _newest(_versions(spark, f"{root}/counts", COUNTS), ["window_start", "window_end", "route_id"], COUNTS.fieldNames())


def refresh_units(spark: SparkSession, pings_path: str, routes: DataFrame, units_path: str,
                  params: Params) -> Callable[[DataFrame, int], None]:
    """foreachBatch body: cluster the live window of the store into a snapshot per batch."""
    def body(batch: DataFrame, batch_id: int) -> None:
        seen = [batch.agg(F.max("ts")).first()[0]]
        if _exists(spark, units_path):
            older = spark.read.parquet(units_path)
            seen.append(older.where(F.col("batch") < batch_id).agg(F.max("as_of")).first()[0])
        as_of = max((t for t in seen if t is not None), default=None)
        if as_of is None:
            return
        lp = live.live_pings(read_pings(spark, pings_path), as_of, params.live_window_s)
        lp = lp.join(routes.where("active").select("route_id"), "route_id", "left_semi")
        units, _ = cluster.detect_units(lp.drop("month"), params.eps_m, params.min_points, ["route_id"])
        clock = spark.createDataFrame([(as_of,)], "as_of timestamp_ntz")  # stays when there are no units
        out = units.withColumn("as_of", F.lit(as_of)).unionByName(clock, allowMissingColumns=True)
        out.write.mode("overwrite").parquet(f"{units_path}/batch={batch_id}")
    return body


def current_units(spark: SparkSession, units_path: str) -> DataFrame:
    """The newest snapshot of the units."""
    rows = spark.read.parquet(units_path)
    last = rows.agg(F.max("batch")).first()[0]
    return rows.where((F.col("batch") == last) & F.col("cluster_id").isNotNull()).drop("batch")
