"""Dimension maintenance as DataFrame rewrites (IO4-IO6, IO9-IO12, C6).

The routes and stops tables are small and are rewritten whole; each function
returns the new version of a table.  Key lookups are equi-joins, never
per-row subqueries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pingpath.operators import traces as tr
from pingpath.operators.live import _instant
from pingpath.sources.tables import overwrite_routes, read_stops


def resolve_codes(rows: DataFrame, routes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows carrying a route ``code`` -> (with route_id, unresolved rows) (IO4, J8)."""
    keyed = rows.join(routes.select("code", "route_id"), "code", "left")
    return (keyed.where(F.col("route_id").isNotNull()).drop("code"),
            keyed.where(F.col("route_id").isNull()).drop("route_id"))


def insert_if_absent(existing: DataFrame, new: DataFrame, key: str, order_by: str) -> DataFrame:
    """``INSERT ... ON CONFLICT (key) DO NOTHING`` (IO5).

    Within ``new`` the first row by ``order_by`` wins a duplicated key; keys
    already present keep their existing row.
    """
    first = (new.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(order_by)))
             .where("_rn = 1").drop("_rn"))
    fresh = first.join(existing.select(key), key, "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Delete every old row whose key occurs in ``new``, then insert ``new`` (IO6)."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def cascade_delete(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Children whose parent row no longer exists disappear (IO9)."""
    return child.join(parent.select(key).distinct(), key, "left_semi")


def update_attribute(df: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """``UPDATE df SET cols = patch.cols WHERE key = patch.key`` (IO10).

    ``patch`` holds the key and the new values; other rows are unchanged.
    """
    cols = [c for c in patch.columns if c != key]
    p = patch.select(key, *[F.col(c).alias("_new_" + c) for c in cols]).withColumn("_hit", F.lit(True))
    j = df.join(p, key, "left")
    for c in cols:
        j = j.withColumn(c, F.when(F.col("_hit"), F.col("_new_" + c)).otherwise(F.col(c)))
    return j.drop("_hit", *["_new_" + c for c in cols]).select(*df.columns)


def update_from_aggregate(routes: DataFrame, stops: DataFrame) -> DataFrame:
    """Routes with ``trace`` rebuilt from their ordered stops (IO11, A5).

    Only routes that have stops are updated, as an UPDATE ... FROM would;
    a route with one stop gets a NULL trace.
    """
    t = tr.build_traces(stops).select("route_id", F.col("trace").alias("_trace"), F.lit(True).alias("_hit"))
    j = routes.join(t, "route_id", "left")
    base = F.col("trace") if "trace" in routes.columns else F.lit(None)
    return j.withColumn("trace", F.when(F.col("_hit"), F.col("_trace")).otherwise(base)).drop("_trace", "_hit")


def stamp_audit(new: DataFrame, old: DataFrame, key: str, as_of) -> DataFrame:
    """created_at kept from the old row (as_of for new keys); updated_at = as_of (IO12).

    Every row present in ``new`` counts as written, so updated_at moves even when
    no value changed, as the update trigger did.
    """
    prev = old.select(key, F.col("created_at").alias("_created"))
    j = new.drop("created_at", "updated_at").join(prev, key, "left")
    now = _instant(as_of)
    return j.withColumn("created_at", F.coalesce(F.col("_created"), now)).withColumn(
        "updated_at", now).drop("_created")


def reload_stops(routes: DataFrame, stops: DataFrame, new_stops_by_code: DataFrame, as_of=None):
    """Replace the stops of the routes named in ``new_stops_by_code``.

    Returns (routes with rebuilt traces, new stops, report, unresolved rows): the
    report has code, n_stops, length_km for every route, the unresolved rows name a
    code that no route has.  If the routes carry audit columns and ``as_of`` is
    given, the routes whose stops were replaced are stamped (IO12).
    """
    resolved, unresolved = resolve_codes(new_stops_by_code, routes)
    new_stops = replace_by_key(stops, resolved.select(*stops.columns), "route_id")
    new_routes = update_from_aggregate(routes, new_stops)
    if as_of is not None and "updated_at" in routes.columns:
        touched = resolved.select("route_id").distinct()
        written = stamp_audit(new_routes.join(touched, "route_id", "left_semi"), routes, "route_id", as_of)
        new_routes = new_routes.join(touched, "route_id", "left_anti").unionByName(written)
    report = (tr.stops_per_route(new_stops, routes)
              .join(tr.trace_length(new_stops), "route_id", "left")
              .select("route_id", "code", "n_stops", "first_stop", "last_stop", "length_km"))
    return new_routes, new_stops, report, unresolved


def reload_stored_stops(spark: SparkSession, path: str, routes: DataFrame, new_stops_by_code: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace the stops of the named routes in the store at ``path`` (C6); returns (report, unresolved rows).

    Only the folders of those routes are written again.
    """
    resolved, unresolved = resolve_codes(new_stops_by_code, routes)
    overwrite_routes(resolved, path)
    stops = read_stops(spark, path)
    report = (tr.stops_per_route(stops, routes).join(tr.trace_length(stops), "route_id", "left")
              .select("route_id", "code", "n_stops", "first_stop", "last_stop", "length_km"))
    return report, unresolved
