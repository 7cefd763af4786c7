"""Data-quality checks on the tables (C10: PF7, PF8, PF11, A8).

One long table (check, subject, n): every violation of the schema rules the
service's database enforced, plus the stop count of every route.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pingpath.config import ROUTE_KINDS
from pingpath.functions import geo


def _rows(df: DataFrame, check: str, subject, n) -> DataFrame:
    return df.select(F.lit(check).alias("check"), subject.cast("string").alias("subject"),
                     n.cast("long").alias("n"))


def ping_checks(pings: DataFrame, routes: DataFrame) -> list[DataFrame]:
    """Constraints of the fact table: key, NOT NULL, route, service envelope (PF8)."""
    missing = [F.col(c).isNull() for c in ("session_hash", "route_id", "lon", "lat", "ts")]
    return [
        _rows(pings.groupBy("ping_id").count().where("count > 1"), "ping_id_duplicate", F.col("ping_id"), F.col("count")),
        _rows(pings.where(reduce(lambda a, b: a | b, missing)), "ping_not_null", F.col("ping_id"), F.lit(1)),
        _rows(pings.where("route_id IS NOT NULL").join(routes.select("route_id").distinct(), "route_id", "left_anti"),
              "ping_orphan", F.col("ping_id"), F.lit(1)),
        _rows(pings.where(~geo.in_envelope(F.col("lon"), F.col("lat"))), "ping_outside", F.col("ping_id"), F.lit(1)),
    ]


def quality_report(routes: DataFrame, stops: DataFrame, pings: DataFrame | None = None) -> DataFrame:
    checks = [
        _rows(routes.where(~F.col("kind").isin(*ROUTE_KINDS) | F.col("kind").isNull()),
              "route_kind_invalid", F.col("code"), F.lit(1)),
        _rows(routes.groupBy("code").count().where("count > 1"),
              "route_code_duplicate", F.col("code"), F.col("count")),
        _rows(routes.groupBy("route_id").count().where("count > 1"),
              "route_id_duplicate", F.col("route_id"), F.col("count")),
        _rows(routes.where(F.col("code").isNull() | F.col("name").isNull()),
              "route_not_null", F.col("route_id"), F.lit(1)),
        _rows(stops.groupBy("stop_id").count().where("count > 1"),
              "stop_id_duplicate", F.col("stop_id"), F.col("count")),
        _rows(stops.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in ("route_id", "lon", "lat")])),
              "stop_not_null", F.col("stop_id"), F.lit(1)),
        _rows(stops.where("route_id IS NOT NULL").join(routes.select("route_id").distinct(), "route_id", "left_anti"),
              "stop_orphan", F.col("stop_id"), F.lit(1)),
        _rows(stops.groupBy("route_id", "seq").count().where("count > 1"),
              "stop_seq_duplicate", F.concat_ws("/", F.col("route_id").cast("string"), F.col("seq").cast("string")),
              F.col("count")),
    ]
    counts = stops.groupBy("route_id").agg(F.count(F.lit(1)).alias("n_stops"))
    per_route = routes.select("route_id", "code", "active").join(counts, "route_id", "left") \
        .withColumn("n_stops", F.coalesce("n_stops", F.lit(0)))
    checks.append(_rows(per_route.where(F.col("active") & (F.col("n_stops") < 2)),
                        "active_route_without_trace", F.col("code"), F.lit(1)))
    checks.append(_rows(per_route, "stops_per_route", F.col("code"), F.col("n_stops")))
    return reduce(DataFrame.unionByName, checks + (ping_checks(pings, routes) if pings is not None else []))
