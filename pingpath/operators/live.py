"""Time-window filters and retention on the ping fact table (PF3, PF4, IO7, IO8, PF10)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pingpath.config import DEMO_PATTERN, PURGE_MESSAGE
from pingpath.functions import geo
from pingpath.sources.rewrite import remove_rows
from pingpath.sources.tables import with_xy


def _instant(as_of):
    """Column for an instant: naive datetimes become TIMESTAMP_NTZ literals."""
    if isinstance(as_of, F.Column):
        return as_of
    if isinstance(as_of, dt.datetime) and as_of.tzinfo is None:
        return F.expr(f"TIMESTAMP_NTZ'{as_of.isoformat(sep=' ')}'")
    return F.lit(as_of)


def _seconds(n: int | float):
    return F.make_dt_interval(secs=F.lit(float(n)))


def live_pings(pings: DataFrame, as_of, window_s: int = 120) -> DataFrame:
    """Pings with ts >= as_of - window (inclusive, no upper bound).

    On a month-partitioned store the implied ``month`` predicate is added so
    whole partitions are pruned; ts itself reaches the Parquet scan as a pushed
    filter, so row groups outside the window are skipped by their statistics.
    """
    lower = _instant(as_of) - _seconds(window_s)
    out = pings.where(F.col("ts") >= lower)
    if "month" in pings.columns:
        out = out.where(F.col("month") >= F.date_format(lower, "yyyy-MM"))
    return out


def with_age(pings: DataFrame, routes: DataFrame, as_of) -> DataFrame:
    """Live pings with route code and age in seconds, newest first (PF4)."""
    joined = pings.join(routes.select("route_id", "code"), "route_id")
    age = F.timestamp_diff("MICROSECOND", F.col("ts"), _instant(as_of))
    return (joined.select("ping_id", "session_hash", "code", "lon", "lat", "ts",
                          (age / 1_000_000.0).alias("age_s"))
            .orderBy(F.col("ts").desc(), "ping_id"))


def _purge_cut(as_of, hours: int):
    return _instant(as_of) - F.make_dt_interval(hours=F.lit(int(hours)))


def purge(pings: DataFrame, as_of, hours: int = 24) -> tuple[DataFrame, DataFrame]:
    """Split into (kept, purged) by ``ts < as_of - hours`` (strict).

    On a month-partitioned store the kept rows lie in the month of the cut and
    later ones, the purged rows in it and earlier ones.
    """
    cut = _purge_cut(as_of, hours)
    old = F.col("ts") < cut
    kept, purged = pings.where(~old | F.col("ts").isNull()), pings.where(old)
    if "month" in pings.columns:
        month = F.date_format(cut, "yyyy-MM")
        kept, purged = kept.where(F.col("month") >= month), purged.where(F.col("month") <= month)
    return kept, purged


def purge_store(spark: SparkSession, path: str, as_of, hours: int = 24) -> DataFrame:
    """Delete expired pings from the month-partitioned store at ``path`` (IO7); returns the report.

    Files that hold only expired pings go, files that hold both are written again, all
    others are not touched.  A job that ends midway loses nothing and can run again
    (``sources.rewrite``); the number purged comes from the scan that finds the files.
    """
    cut = _purge_cut(as_of, hours)
    n = remove_rows(spark, path, F.col("ts") < cut, F.col("month") <= F.date_format(cut, "yyyy-MM"))
    return _report(spark.range(1).select(F.lit(n).cast("long").alias("purged")), hours)


def purge_report(pings: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """One row: number purged and the service's message text (IO7)."""
    _, purged = purge(pings, as_of, hours)
    return _report(purged.agg(F.count(F.lit(1)).alias("purged")), hours)


def _report(n: DataFrame, hours: int) -> DataFrame:
    return n.select("purged", F.format_string(PURGE_MESSAGE, F.col("purged"), F.lit(int(hours))).alias("message"))


def delete_sessions_like(pings: DataFrame, pattern: str = DEMO_PATTERN) -> DataFrame:
    """Rows kept after ``DELETE ... WHERE session_hash LIKE pattern`` (IO8)."""
    return pings.where(~F.col("session_hash").like(pattern))


def delete_stored_sessions_like(spark: SparkSession, path: str, pattern: str = DEMO_PATTERN) -> int:
    """``DELETE ... WHERE session_hash LIKE pattern`` on the store at ``path`` (IO8); returns the number deleted.

    Only files with a match are written again.
    """
    return remove_rows(spark, path, F.col("session_hash").like(pattern))


def within_radius(pings: DataFrame, lon0: float, lat0: float, radius_m: float) -> DataFrame:
    """Pings within ``radius_m`` metres of a point (PF10).

    A lon/lat box goes first so Parquet can skip row groups; the exact ellipsoidal
    test runs on what is left, from the stored UTM positions.
    """
    w, s, e, n = geo.bbox_around(lon0, lat0, radius_m)
    boxed = with_xy(pings.where(F.col("lon").between(w, e) & F.col("lat").between(s, n)))
    qx, qy = geo.utm_of(lon0, lat0)
    d = geo.geodesic_m(F.col("x"), F.col("y"), F.col("lat"), F.lit(qx), F.lit(qy), F.lit(lat0))
    return boxed.withColumn("distance_m", d).where(F.col("distance_m") <= radius_m)
