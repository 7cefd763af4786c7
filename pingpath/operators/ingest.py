"""Ping ingest with validation and a quarantine table (C5: PF5, PF2, J4, PF6, A6).

Checks run in the service's order and the first failing one names the reason:

1. payload: device id 8..64 chars (``payload_uuid``), route code 1..10 chars
   (``payload_code``), lat/lon inside the inclusive bounds (``payload_bounds``),
   an instant (``payload_ts``; the service stamps one, a table may lack it), a
   salt for its day (``payload_salt``, only with daily salts);
2. rate limit: a stored ping of the same session less than W earlier (``rate``);
3. route: the code names no active route (``route``);
4. corridor: farther than the corridor from the route line (``corridor``);
   routes without a line accept every position;
5. envelope: outside the strict service envelope (``envelope``).

Rows that repeat a ping_id are one attempt (``once``), so a sender may try again.
Only accepted attempts hold a rate-limit slot.  The device id is replaced by
``sha256("<uuid>:<salt>")`` before anything is stored, in both outputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pingpath import config as C
from pingpath.config import Params
from pingpath.functions import geo
from pingpath.operators.corridor import distance_to_trace
from pingpath.operators.ratelimit import decide, epoch_micros
from pingpath.session import materialise

CHECKED = ["ping_id", "session_hash", "code", "route_id", "lon", "lat", "x", "y", "ts"]


def anonymise(raw: DataFrame, salt: str | None = None, salts: DataFrame | None = None) -> DataFrame:
    """Replace ``uuid`` by ``session_hash``.

    With ``salts`` (day DATE, salt STRING) each day uses its own salt, as a daily
    rotating salt would; a day without one has no hash and no row of it can be
    stored.  Otherwise ``salt`` is required.
    """
    if salts is None and not salt:
        raise ValueError("a salt (or a table of daily salts) is required")
    if salts is not None:
        daily = salts.select(F.col("day").alias("_day"), F.col("salt").alias("_salt"))
        raw = raw.withColumn("_day", F.to_date("ts")).join(daily, "_day", "left")
        s = F.col("_salt")
    else:
        s = F.lit(salt)
    out = raw.withColumn("session_hash", F.sha2(F.concat(F.col("uuid"), F.lit(":"), s), 256))
    return out.drop("uuid", "_day", "_salt")


def payload_reason():
    uuid_len = F.length("uuid")
    code_len = F.length("code")
    return (F.when(F.col("uuid").isNull() | ~uuid_len.between(C.UUID_LEN_MIN, C.UUID_LEN_MAX), "payload_uuid")
            .when(F.col("code").isNull() | ~code_len.between(C.CODE_LEN_MIN, C.CODE_LEN_MAX), "payload_code")
            .when(F.col("lat").isNull() | F.col("lon").isNull()
                  | ~F.col("lat").between(C.PAYLOAD_LAT_MIN, C.PAYLOAD_LAT_MAX)
                  | ~F.col("lon").between(C.PAYLOAD_LON_MIN, C.PAYLOAD_LON_MAX), "payload_bounds")
            .when(F.col("ts").isNull(), "payload_ts"))


def once(raw: DataFrame) -> DataFrame:
    """One row for each ping_id: an attempt that was sent again is the same attempt.

    Of different attempts under one id the least (instant, device, code, position) is it.
    """
    rest = [c for c in ("ts", "uuid", "code", "lon", "lat") if c in raw.columns]
    rest += [c for c in raw.columns if c not in (*rest, "ping_id")]
    return (raw.groupBy("ping_id").agg(F.min(F.struct(*rest)).alias("_least"))
            .select(*[F.col(c) if c == "ping_id" else F.col(f"_least.{c}").alias(c) for c in raw.columns]))


def check(raw: DataFrame, routes: DataFrame, stops: DataFrame, params: Params,
          salts: DataFrame | None = None) -> DataFrame:
    """Every attempt with the outcome of all checks that look at one row (``CHECKED`` + reasons).

    Rows meet the routes and the segments of their grid cell; the planner
    broadcasts those dimensions by their measured size.
    """
    df = anonymise(raw.withColumn("_payload", payload_reason()), params.salt, salts)
    active = routes.where(F.col("active")).select("code", "route_id")
    df = distance_to_trace(df.join(active, "code", "left"), stops, params.corridor_m)
    payload = F.coalesce(F.col("_payload"), F.when(F.col("session_hash").isNull(), "payload_salt"))
    stateless = (F.when(F.col("route_id").isNull(), "route")
                 .when(F.col("beyond_corridor"), "corridor")
                 .when(~geo.in_envelope(F.col("lon"), F.col("lat")), "envelope"))
    return df.select(*CHECKED, "trace_distance_m", payload.alias("payload_reason"), stateless.alias("stateless_reason"))


def attempts_of(checked: DataFrame) -> DataFrame:
    """The narrow rows the rate limit works on."""
    return checked.select(F.col("session_hash").alias("sid"), F.col("ping_id").alias("id"),
                          epoch_micros(checked, "ts").alias("us"),
                          F.col("payload_reason").isNull().alias("payload_ok"),
                          F.col("stateless_reason").isNull().alias("valid"))


def with_reason(checked: DataFrame, decisions: DataFrame) -> DataFrame:
    """``checked`` with reject_reason; NULL only for rows the rate limit accepted."""
    d = decisions.select(F.col("id").alias("ping_id"), "accepted", "rate_limited")
    reason = (F.when(F.col("payload_reason").isNotNull(), F.col("payload_reason"))
              .when(F.col("rate_limited"), F.lit("rate"))
              .when(F.col("accepted"), F.lit(None).cast("string"))
              .otherwise(F.coalesce(F.col("stateless_reason"), F.lit("rate"))))
    return (checked.join(d, "ping_id", "left").withColumn("reject_reason", reason)
            .drop("payload_reason", "stateless_reason", "accepted", "rate_limited"))


def classify(raw: DataFrame, routes: DataFrame, stops: DataFrame, params: Params,
             salts: DataFrame | None = None) -> DataFrame:
    """Every attempt with route_id, session_hash, trace distance and reject_reason (NULL = accepted).

    The checks of single rows are written once, columnar; the rate limit reads four
    narrow columns of them, and its decisions join back once.
    """
    checked = materialise(check(once(raw), routes, stops, params, salts), "ingest-checked")
    decisions = materialise(decide(attempts_of(checked), params.rate_limit_s), "ingest-decisions")
    return with_reason(checked, decisions)


def accepted_rows(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("reject_reason").isNull()).select(
        "ping_id", "session_hash", F.col("route_id").cast("int").alias("route_id"), "lon", "lat", "ts", "x", "y")


def rejected_rows(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("reject_reason").isNotNull()).select(
        "ping_id", "session_hash", "code", "lon", "lat", "ts", "reject_reason")


def ingest(raw: DataFrame, routes: DataFrame, stops: DataFrame, params: Params,
           salts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted pings with UTM x and y, rejected attempts) from raw attempts."""
    classified = classify(raw, routes, stops, params, salts)
    return accepted_rows(classified), rejected_rows(classified)
