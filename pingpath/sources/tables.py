"""Table schemas, readers and the partitioned ping store (IO1, IO2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pingpath.functions import geo

ROUTES = T.StructType([
    T.StructField("route_id", T.IntegerType(), False),
    T.StructField("code", T.StringType(), False),
    T.StructField("name", T.StringType(), True),
    T.StructField("kind", T.StringType(), True),
    T.StructField("active", T.BooleanType(), True),
])

STOPS = T.StructType([
    T.StructField("stop_id", T.LongType(), False),
    T.StructField("route_id", T.IntegerType(), False),
    T.StructField("name", T.StringType(), True),
    T.StructField("lon", T.DoubleType(), False),
    T.StructField("lat", T.DoubleType(), False),
    T.StructField("seq", T.IntegerType(), True),
])

RAW_PINGS = T.StructType([
    T.StructField("ping_id", T.LongType(), False),
    T.StructField("uuid", T.StringType(), True),
    T.StructField("code", T.StringType(), True),
    T.StructField("lon", T.DoubleType(), True),
    T.StructField("lat", T.DoubleType(), True),
    T.StructField("ts", T.TimestampNTZType(), True),
])

PINGS = T.StructType([
    T.StructField("ping_id", T.LongType(), False),
    T.StructField("session_hash", T.StringType(), False),
    T.StructField("route_id", T.IntegerType(), False),
    T.StructField("lon", T.DoubleType(), False),
    T.StructField("lat", T.DoubleType(), False),
    T.StructField("ts", T.TimestampNTZType(), False),
])

PING_COLUMNS = [f.name for f in PINGS.fields]

#: The stored fact table: pings with their UTM position, by month.
STORE = T.StructType([*PINGS.fields, T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()),
                      T.StructField("month", T.StringType())])


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet scan with an explicit schema (no inference on large inputs)."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(path)


def month_of(ts) -> "F.Column":
    return F.date_format(ts, "yyyy-MM")


def write_pings(pings: DataFrame, path: str, mode: str = "append") -> None:
    """Month-partitioned ping store, rows ranged by (month, route, ts) over files.

    Ranges give tight Parquet min/max statistics on route_id and ts, which is what
    row-group skipping needs for the live window, and cut a busy route's month into
    as many files as it needs.
    """
    (with_xy(pings).withColumn("month", month_of(F.col("ts")))
     .repartitionByRange("month", "route_id", "ts")
     .sortWithinPartitions("month", "route_id", "ts")
     .write.mode(mode).partitionBy("month").parquet(path))


def with_xy(pings: DataFrame) -> DataFrame:
    """Pings with their UTM position, added where a source has none."""
    return pings if "x" in pings.columns else geo.add_utm(pings, "lon", "lat", "x", "y")


def read_pings(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, STORE)


def write_stops(stops: DataFrame, path: str) -> None:
    """Route-partitioned stop store: a folder a route, so a route is replaced without touching the others."""
    stops.repartition("route_id").sortWithinPartitions("route_id", "seq", "stop_id").write.mode("overwrite").partitionBy("route_id").parquet(path)


def read_stops(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, STOPS).select(*STOPS.fieldNames())


def overwrite_routes(new: DataFrame, path: str) -> None:
    """Replace the stops of every route that ``new`` names; files of other routes stay as they are (IO6)."""
    (new.select(*STOPS.fieldNames()).repartition("route_id").sortWithinPartitions("route_id", "seq", "stop_id").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("route_id").parquet(path))
