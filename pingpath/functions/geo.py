"""Geodesy as Spark Column expressions (JVM-side, no UDF).

Points are two DOUBLE columns (lon, lat) in WGS84 degrees.  Planar work runs in
UTM zone 13 North metres (transverse Mercator, Krueger n-series to 4th order);
geodesic metres are the planar UTM distance divided by the line scale factor
(Simpson's rule over the point scale at both ends and the midpoint).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# WGS84 ellipsoid and UTM zone 13 North.
# ---------------------------------------------------------------------------
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
UTM_LON0_DEG = -105.0
UTM_K0 = 0.9996
UTM_FALSE_EASTING = 500000.0
UTM_FALSE_NORTHING = 0.0
# ---------------------------------------------------------------------------

_N = WGS84_F / (2 - WGS84_F)
_E2 = WGS84_F * (2 - WGS84_F)
_E = math.sqrt(_E2)
_A_RECT = WGS84_A / (1 + _N) * (1 + _N ** 2 / 4 + _N ** 4 / 64)
_KA = UTM_K0 * _A_RECT
_LON0 = math.radians(UTM_LON0_DEG)

# Krueger series coefficients (standard expansions in the third flattening n).
ALPHA = (
    _N / 2 - 2 * _N ** 2 / 3 + 5 * _N ** 3 / 16 + 41 * _N ** 4 / 180,
    13 * _N ** 2 / 48 - 3 * _N ** 3 / 5 + 557 * _N ** 4 / 1440,
    61 * _N ** 3 / 240 - 103 * _N ** 4 / 140,
    49561 * _N ** 4 / 161280,
)
BETA = (
    _N / 2 - 2 * _N ** 2 / 3 + 37 * _N ** 3 / 96 - _N ** 4 / 360,
    _N ** 2 / 48 + _N ** 3 / 15 - 437 * _N ** 4 / 1440,
    17 * _N ** 3 / 480 - 37 * _N ** 4 / 840,
    4397 * _N ** 4 / 161280,
)
DELTA = (
    2 * _N - 2 * _N ** 2 / 3 - 2 * _N ** 3 + 116 * _N ** 4 / 45,
    7 * _N ** 2 / 3 - 8 * _N ** 3 / 5 - 227 * _N ** 4 / 45,
    56 * _N ** 3 / 15 - 136 * _N ** 4 / 35,
    4279 * _N ** 4 / 630,
)

CONST = {
    "ka": _KA, "e": _E, "e2": _E2, "lon0": _LON0, "k0": UTM_K0,
    "fe": UTM_FALSE_EASTING, "fn": UTM_FALSE_NORTHING, "a": WGS84_A,
}


def _lit(v: float) -> Column:
    return F.lit(float(v))


def to_utm(lon: Column, lat: Column) -> tuple[Column, Column]:
    """(easting, northing) in metres for WGS84 (lon, lat) degrees."""
    phi = F.radians(lat)
    lam = F.radians(lon) - _lit(_LON0)
    sphi = F.sin(phi)
    t = F.sinh(F.atanh(sphi) - _lit(_E) * F.atanh(_lit(_E) * sphi))
    xi = F.atan(t / F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(F.lit(1.0) + t * t))
    east = eta
    north = xi
    for j, a in enumerate(ALPHA, start=1):
        east = east + _lit(a) * F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j))
        north = north + _lit(a) * F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j))
    return (_lit(UTM_FALSE_EASTING) + _lit(_KA) * east,
            _lit(UTM_FALSE_NORTHING) + _lit(_KA) * north)


def utm_of(lon: float, lat: float) -> tuple[float, float]:
    """(easting, northing) of one point, as plain numbers."""
    phi, lam = math.radians(lat), math.radians(lon) - _LON0
    t = math.sinh(math.atanh(math.sin(phi)) - _E * math.atanh(_E * math.sin(phi)))
    xi, eta = math.atan(t / math.cos(lam)), math.atanh(math.sin(lam) / math.sqrt(1 + t * t))
    east = eta + sum(a * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, a in enumerate(ALPHA, start=1))
    north = xi + sum(a * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, a in enumerate(ALPHA, start=1))
    return UTM_FALSE_EASTING + _KA * east, UTM_FALSE_NORTHING + _KA * north


def add_utm(df, lon: str = "lon", lat: str = "lat", x: str = "x", y: str = "y"):
    """Add UTM columns, written in stages for readability (the optimizer may inline them)."""
    phi = F.radians(F.col(lat))
    lam = F.radians(F.col(lon)) - _lit(_LON0)
    sphi = F.sin(phi)
    df = df.withColumn("_t", F.sinh(F.atanh(sphi) - _lit(_E) * F.atanh(_lit(_E) * sphi))) \
           .withColumn("_lam", lam)
    df = df.withColumn("_xi", F.atan(F.col("_t") / F.cos(F.col("_lam")))) \
           .withColumn("_eta", F.atanh(F.sin(F.col("_lam")) / F.sqrt(F.lit(1.0) + F.col("_t") * F.col("_t"))))
    xi, eta = F.col("_xi"), F.col("_eta")
    east, north = eta, xi
    for j, a in enumerate(ALPHA, start=1):
        east = east + _lit(a) * F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j))
        north = north + _lit(a) * F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j))
    df = df.withColumn(x, _lit(UTM_FALSE_EASTING) + _lit(_KA) * east) \
           .withColumn(y, _lit(UTM_FALSE_NORTHING) + _lit(_KA) * north)
    return df.drop("_t", "_lam", "_xi", "_eta")


def add_lonlat(df, x: str = "x", y: str = "y", lon: str = "lon", lat: str = "lat"):
    """Add WGS84 lon/lat columns from UTM columns, in stages."""
    df = df.withColumn("_xi", (F.col(y) - _lit(UTM_FALSE_NORTHING)) / _lit(_KA)) \
           .withColumn("_eta", (F.col(x) - _lit(UTM_FALSE_EASTING)) / _lit(_KA))
    xi, eta = F.col("_xi"), F.col("_eta")
    xi1, eta1 = xi, eta
    for j, b in enumerate(BETA, start=1):
        xi1 = xi1 - _lit(b) * F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j))
        eta1 = eta1 - _lit(b) * F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j))
    df = df.withColumn("_xi1", xi1).withColumn("_eta1", eta1)
    df = df.withColumn("_chi", F.asin(F.sin(F.col("_xi1")) / F.cosh(F.col("_eta1"))))
    chi = F.col("_chi")
    phi = chi
    for j, d in enumerate(DELTA, start=1):
        phi = phi + _lit(d) * F.sin(chi * (2 * j))
    lam = _lit(_LON0) + F.atan(F.sinh(F.col("_eta1")) / F.cos(F.col("_xi1")))
    df = df.withColumn(lon, F.degrees(lam)).withColumn(lat, F.degrees(phi))
    return df.drop("_xi", "_eta", "_xi1", "_eta1", "_chi")


def point_scale(x: Column, lat: Column) -> Column:
    """Transverse Mercator point scale factor at easting ``x`` and latitude ``lat``."""
    s = F.sin(F.radians(lat))
    w = F.lit(1.0) - _lit(_E2) * s * s
    rho_nu = _lit(WGS84_A * WGS84_A * (1 - _E2)) / (w * w)
    u = (x - _lit(UTM_FALSE_EASTING)) / _lit(UTM_K0)
    q = u * u / rho_nu
    return _lit(UTM_K0) * (F.lit(1.0) + q / 2 + q * q / 24)


def geodesic_m(x1: Column, y1: Column, lat1: Column,
               x2: Column, y2: Column, lat2: Column) -> Column:
    """Ellipsoidal distance in metres between two nearby points given in UTM."""
    grid = F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))
    k1 = point_scale(x1, lat1)
    k2 = point_scale(x2, lat2)
    km = point_scale((x1 + x2) / 2, (lat1 + lat2) / 2)
    return grid * 6.0 / (k1 + km * 4.0 + k2)


def segment_grid_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Planar UTM metres from point P to segment AB."""
    dx = bx - ax
    dy = by - ay
    len2 = dx * dx + dy * dy
    t = F.when(len2 > 0, ((px - ax) * dx + (py - ay) * dy) / len2).otherwise(F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    cx = ax + t * dx
    cy = ay + t * dy
    return F.sqrt((px - cx) * (px - cx) + (py - cy) * (py - cy))


def degree_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Planar distance in degrees (the KNN ordering of the original service)."""
    return F.sqrt((lon2 - lon1) * (lon2 - lon1) + (lat2 - lat1) * (lat2 - lat1))


def round_half_up(x: Column, digits: int = 1) -> Column:
    """ROUND(x::numeric, digits) for x >= 0: half away from zero."""
    scale = float(10 ** digits)
    return F.floor(x * scale + 0.5) / scale


def in_envelope(lon: Column, lat: Column, envelope=None) -> Column:
    from pingpath.config import ENVELOPE
    w, s, e, n = envelope or ENVELOPE
    return (lon > w) & (lon < e) & (lat > s) & (lat < n)


def bbox_around(lon0: float, lat0: float, radius_m: float) -> tuple[float, float, float, float]:
    """Conservative lon/lat box containing every point within ``radius_m``."""
    dlat = radius_m / 110000.0 * 1.01
    dlon = radius_m / (111000.0 * math.cos(math.radians(abs(lat0) + dlat + 0.5))) * 1.01
    return lon0 - dlon, lat0 - dlat, lon0 + dlon, lat0 + dlat
