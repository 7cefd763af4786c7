"""Distinct sessions as mergeable sketches per route and day.

A day's sketch is written once and never read from pings again: distinct sessions of
any span of days, of any set of routes or of everything are unions of sketches, some
kilobytes each, so a month of history costs days x routes rows however many pings it
holds.  ``LG_K`` bounds a sketch (2**LG_K registers) and its error (about
1.04 / sqrt(2**LG_K), 0.8 %; nearly exact below some thousand sessions).

Defined cases: rows without a session count as pings, not as sessions; a null route or
instant is a group of its own; rows repeated change no distinct count; an empty table
gives no groups (and no estimate where everything is one group).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG_K = 14


def daily_sketches(pings: DataFrame) -> DataFrame:
    """(route_id, day, pings, sketch), one row per route and day; partial sketches merge before the shuffle."""
    return pings.groupBy("route_id", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("pings"), F.hll_sketch_agg("session_hash", LG_K).alias("sketch"))


def merge(sketches: DataFrame, *keys: str) -> DataFrame:
    """Sketches of wider groups: ``keys`` of daily sketches, or of merged ones; no key merges everything."""
    return sketches.groupBy(*keys).agg(F.sum("pings").alias("pings"), F.hll_union_agg("sketch").alias("sketch"))


def distinct_sessions(sketches: DataFrame) -> DataFrame:
    """The sketches' groups with ``sessions``, the estimated number of distinct sessions."""
    return sketches.withColumn("sessions", F.hll_sketch_estimate("sketch")).drop("sketch")
