"""Adapter from the benchmark tables to the ping data model.

The benchmark folder holds generic tables (region, nation, supplier, events).
Routes, stops and raw pings are derived from them with plain arithmetic that
gives bit-identical doubles in Spark and in a SQL engine (see FIXTURES.md):

* routes  <- region:  route_id = r_regionkey + 1, code 'R<k>', kind by k % 3,
  region 4 inactive; and a sixth route 'R5' of an unknown kind, without stops;
* stops   <- supplier joined to nation: one stop per supplier on route
  n_regionkey + 1, ordered by s_suppkey, spread north over the service area;
* raw pings <- events: one ping attempt per event near a stop of route
  event_id % 6 + 1, device id from user_id.  Some attempts have a defect, so that
  every check has something to refuse: a short device id, a long route code, no
  instant, a position on the edge of the service area (on the route without line).

The events are sparse (minutes between rows), so runs on this data use a one
day live window and a six hour rate limit (``DRIVER_PARAMS``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pingpath.config import Params

DRIVER_PARAMS = Params(live_window_s=86400, rate_limit_s=6 * 3600, salt="benchmark-tables")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _table(spark, sf_dir, "region")
    k = F.col("r_regionkey")
    lines = r.select(
        (k + 1).cast("int").alias("route_id"),
        F.concat(F.lit("R"), k.cast("string")).alias("code"),
        F.col("r_name").alias("name"),
        F.when(k % 3 == 0, "tren_ligero").when(k % 3 == 1, "autobus")
         .otherwise("alimentador").alias("kind"),
        (k != 4).alias("active"),
    )
    bare = r.where(k == 0).select(F.lit(6).alias("route_id"), F.lit("R5").alias("code"),
                                  F.concat("r_name", F.lit(" BIS")).alias("name"),
                                  F.lit("teleferico").alias("kind"), F.lit(True).alias("active"))
    return lines.unionByName(bare)


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    n = _table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    joined = s.join(n, s.s_nationkey == n.n_nationkey)
    by_route = Window.partitionBy("n_regionkey")
    seq = F.row_number().over(by_route.orderBy("s_suppkey"))
    df = joined.select(
        F.col("s_suppkey").alias("stop_id"),
        (F.col("n_regionkey") + 1).cast("int").alias("route_id"),
        F.col("s_name").alias("name"),
        F.col("n_regionkey"),
        seq.alias("seq"),
        F.count(F.lit(1)).over(by_route).alias("cnt"),
    )
    return df.select(
        "stop_id", "route_id", "name",
        (F.lit(-103.50) + F.lit(0.07) * F.col("n_regionkey")
         + F.lit(0.002) * (F.col("seq") % 3)).alias("lon"),
        (F.lit(20.45) + F.lit(0.35) * F.col("seq") / (F.col("cnt") + 1)).alias("lat"),
        F.col("seq").cast("int").alias("seq"),
    )


def attempts_from_events(ev: DataFrame, st: DataFrame) -> DataFrame:
    """Ping attempts (ping_id, uuid, code, lon, lat, ts) from rows of ``events``."""
    counts = st.groupBy("route_id").agg(F.count(F.lit(1)).alias("cnt"))
    eid = F.col("event_id")
    ev = ev.select("event_id", "ts", "user_id", "event_type", "value").withColumn("route_id", (eid % 6 + 1).cast("int"))
    ev = ev.join(counts, "route_id", "left")
    ev = ev.withColumn("seq", (F.expr("event_id div 6") % F.col("cnt") + 1).cast("int"))
    stop_pos = st.select("route_id", "seq", F.col("lon").alias("s_lon"), F.col("lat").alias("s_lat"))
    ev = ev.join(stop_pos, ["route_id", "seq"], "left")
    base_lon = F.coalesce(F.col("s_lon"), F.lit(-103.35))
    base_lat = F.coalesce(F.col("s_lat"), F.lit(20.6))
    lon = base_lon + ((eid * 7) % 5 - 2) * F.lit(0.00005)
    lon = F.when(F.col("event_type") == "error", lon + F.lit(0.005)).otherwise(lon)
    lat = (F.when(F.col("value") > 150, F.lit(20.39))
           .when((F.col("route_id") == 6) & (eid % 11 == 5), F.lit(20.40))
           .otherwise(base_lat + ((eid * 11) % 7 - 3) * F.lit(0.00004)))
    user = F.col("user_id").cast("string")
    device = F.concat(F.lit("device-"), F.lpad(user, F.greatest(F.lit(6), F.length(user)), F.lit("0")))
    return ev.select(
        eid.alias("ping_id"),
        F.when(eid % 97 == 3, F.concat(F.lit("d-"), (F.col("user_id") % 1000).cast("string"))).otherwise(device).alias("uuid"),
        F.concat(F.lit("R"), (eid % 6).cast("string"), F.when(eid % 89 == 7, F.lit("-TOO-LONG")).otherwise("")).alias("code"),
        lon.alias("lon"),
        lat.alias("lat"),
        F.when(eid % 83 != 11, F.col("ts")).alias("ts"),
    )


def raw_pings(spark: SparkSession, sf_dir: str, stop_df: DataFrame | None = None) -> DataFrame:
    return attempts_from_events(_table(spark, sf_dir, "events"), stop_df if stop_df is not None else stops(spark, sf_dir))


def as_of(spark: SparkSession, sf_dir: str):
    """The evaluation instant for driver data: the newest event time."""
    return _table(spark, sf_dir, "events").agg(F.max("ts")).first()[0]
