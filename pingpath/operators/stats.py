"""Per-route statistics and the small client-side summaries (A1, A2, A10, A11, PF1, PF9, PF12, PF13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pingpath.config import AGE_MINUTES, AGE_NONE, AGE_SECONDS, GEOJSON_DIGITS
from pingpath.operators.live import _instant


def route_stats(live: DataFrame, routes: DataFrame, units: DataFrame) -> DataFrame:
    """Active routes with live ping and vehicle counts, zero when none.

    Pings are counted per route before the join (one row per route reaches it).
    """
    pings = live.groupBy("route_id").agg(F.count(F.lit(1)).alias("live_pings"))
    veh = units.groupBy("route_id").agg(F.count(F.lit(1)).alias("units"))
    act = routes.where(F.col("active")).select("route_id", "code", "kind")
    return (act.join(pings, "route_id", "left").join(veh, "route_id", "left")
            .select("route_id", "code", "kind",
                    F.coalesce("live_pings", F.lit(0)).alias("live_pings"),
                    F.coalesce("units", F.lit(0)).alias("units")))


def live_total(live: DataFrame, window_minutes: int) -> DataFrame:
    """All live pings, whatever their route."""
    return live.agg(F.count(F.lit(1)).alias("live_pings_total")).withColumn(
        "window_minutes", F.lit(int(window_minutes)))


def dashboard(stats: DataFrame) -> DataFrame:
    """Totals of the statistics screen (A10)."""
    return stats.agg(
        F.coalesce(F.sum("units"), F.lit(0)).cast("long").alias("total_units"),
        F.count(F.when(F.col("live_pings") > 0, 1)).alias("routes_with_pings"),
        F.count(F.lit(1)).alias("n_routes"))


def active_routes_list(routes: DataFrame) -> DataFrame:
    """code, name, kind of active routes by code (PF1)."""
    return routes.where(F.col("active")).select("code", "name", "kind").orderBy("code")


def search_routes(routes: DataFrame, term: str) -> DataFrame:
    """Case-insensitive substring match on code or name (PF9)."""
    t = term.lower()
    return routes.where(F.lower("code").contains(t) | F.lower("name").contains(t))


def routes_by_kind(routes: DataFrame, term: str = "") -> DataFrame:
    """Active routes grouped by kind in order of first appearance by code.

    Kinds are ranked by their least code, after grouping: one row a kind.
    """
    lst = search_routes(active_routes_list(routes), term) if term else active_routes_list(routes)
    kinds = lst.groupBy("kind").agg(F.count(F.lit(1)).alias("n_routes"), F.min("code").alias("first_code"))
    return kinds.withColumn("position", F.row_number().over(Window.orderBy("first_code"))).orderBy("position")


def unit_labels(units: DataFrame, as_of) -> DataFrame:
    """Confidence share and band, and the 'hace Ns / N min' age label (PF12)."""
    ms = F.timestamp_diff("MILLISECOND", F.col("last_ts"), _instant(as_of))
    s = F.floor(ms / 1000.0 + 0.5).cast("long")
    label = F.when(F.col("last_ts").isNull(), F.lit(AGE_NONE)).when(
        s < 60, F.format_string(AGE_SECONDS, s)).otherwise(
        F.format_string(AGE_MINUTES, F.floor(s / 60.0 + 0.5).cast("long")))
    band = (F.when(F.col("report_count") >= 3, "high").when(F.col("report_count") == 2, "medium")
            .otherwise("low"))
    return units.select("*", F.least(F.col("report_count") / 5.0, F.lit(1.0)).alias("confidence"),
                        band.alias("band"), label.alias("age_label"))


def route_bbox(traces: DataFrame) -> DataFrame:
    """Bounds of each trace and its points as [lat, lon] pairs, only with 2+ points (PF13)."""
    lat, lon = F.col("trace.lat"), F.col("trace.lon")
    return traces.where(F.size("trace") >= 2).select(
        "route_id", F.array_min(lat).alias("south"), F.array_min(lon).alias("west"),
        F.array_max(lat).alias("north"), F.array_max(lon).alias("east"),
        F.transform("trace", lambda p: F.array(F.round(p["lat"], GEOJSON_DIGITS), F.round(p["lon"], GEOJSON_DIGITS))).alias("latlon"))
