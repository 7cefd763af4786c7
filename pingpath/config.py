"""Parameters of the ping analytics jobs.

Every job takes these as arguments; the defaults below are the values of the
service being reproduced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values (must equal the original service for identical results)
# ---------------------------------------------------------------------------
# Payload bounds, inclusive: latitude 20.40..20.85, longitude -103.55..-103.15.
PAYLOAD_LAT_MIN, PAYLOAD_LAT_MAX = 20.40, 20.85
PAYLOAD_LON_MIN, PAYLOAD_LON_MAX = -103.55, -103.15
# Device id length 8..64 characters, route code length 1..10 characters.
UUID_LEN_MIN, UUID_LEN_MAX = 8, 64
CODE_LEN_MIN, CODE_LEN_MAX = 1, 10
# Table envelope (west, south, east, north), strict containment.
ENVELOPE = (-103.55, 20.40, -103.15, 20.85)
# Allowed route kinds.
ROUTE_KINDS = ("tren_ligero", "autobus", "alimentador")
# ETA speed in metres per minute: 583 for tren_ligero, 300 for every other kind.
SPEEDS_M_PER_MIN = {"tren_ligero": 583.0}
DEFAULT_SPEED_M_PER_MIN = 300.0
# Clustering: eps 20 m in UTM zone 13N metres, minimum 2 points (self included).
EPS_M = 20.0
MIN_POINTS = 2
# Live window 2 minutes; rate limit 10 s per session; corridor 100 m; 3 nearest stops.
LIVE_WINDOW_S = 120
RATE_LIMIT_S = 10
CORRIDOR_M = 100.0
NEAREST_K = 3
PURGE_HOURS = 24
# Session hash: sha256 hex of "<uuid>:<salt>"; the salt is a parameter without default.
# Demo-session pattern removed before demo inserts.
DEMO_PATTERN = "demo_%"
# Texts: purge message (count, hours) and age labels (seconds, minutes, none).
PURGE_MESSAGE = "OK: %s pings purgados (antigüedad > %s horas)."
AGE_SECONDS, AGE_MINUTES, AGE_NONE = "hace %ds", "hace %d min", "justo ahora"
# GeoJSON coordinates have at most 9 decimals.
GEOJSON_DIGITS = 9
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Params:
    """Job parameters; override per run (e.g. the driver-data adapter)."""

    live_window_s: int = LIVE_WINDOW_S
    rate_limit_s: int = RATE_LIMIT_S
    corridor_m: float = CORRIDOR_M
    eps_m: float = EPS_M
    min_points: int = MIN_POINTS
    nearest_k: int = NEAREST_K
    # secret that hashes device ids; ingest refuses to run without it or a table of daily salts
    salt: str | None = None
    speeds: dict = field(default_factory=lambda: dict(SPEEDS_M_PER_MIN))
    default_speed: float = DEFAULT_SPEED_M_PER_MIN
