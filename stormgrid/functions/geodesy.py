"""Distances, longitudes and cell keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth radii used by the distance formulas.
EARTH_RADIUS_M = 6371000.0
EARTH_RADIUS_KM = 6371.0
EXTENT_RADIUS_KM = 6373.0

# A cell key packs (t, y, x) so that its order is the row-major cell order on any
# grid of up to 2^20 x 2^20 cells; no grid shape is needed to build it.
KEY_BITS = 20


def _half_chord(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    phi1, phi2 = F.radians(lat1), F.radians(lat2)
    s_lat = F.sin((phi2 - phi1) / 2)
    s_lon = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    return s_lat * s_lat + F.cos(phi1) * F.cos(phi2) * s_lon * s_lon


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    return F.asin(F.sqrt(_half_chord(lat1, lon1, lat2, lon2))) * 2 * EARTH_RADIUS_M


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in kilometres; longitude comes first."""
    return F.asin(F.sqrt(_half_chord(lat1, lon1, lat2, lon2))) * 2 * EARTH_RADIUS_KM


def great_circle_km(
    lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EXTENT_RADIUS_KM
) -> Column:
    """Great-circle distance in kilometres in the atan2 form, stable for antipodes."""
    a = _half_chord(lat1, lon1, lat2, lon2)
    return F.atan2(F.sqrt(a), F.sqrt(1 - a)) * 2 * radius


def cosine_distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Spherical law of cosines; rounding above 1 is clamped so acos stays defined."""
    phi1, phi2 = F.radians(lat1), F.radians(lat2)
    c = F.sin(phi1) * F.sin(phi2) + F.cos(phi1) * F.cos(phi2) * F.cos(
        F.radians(lon2) - F.radians(lon1)
    )
    return F.acos(F.when(c > 1, 1.0).otherwise(c)) * EARTH_RADIUS_M


def normalize_lon(lon: Column) -> Column:
    """Longitudes of 0..360 moved to -180..180."""
    return F.when(lon >= 180, lon - 360).otherwise(lon)


def roll_x(x: Column, n: int, nx: int) -> Column:
    """Index after rotating a row of ``nx`` cells by ``n`` places."""
    return F.pmod(x + F.lit(n), F.lit(nx))


def cell_id(t: Column, y: Column, x: Column, ny: int, nx: int) -> Column:
    """Row-major linear index of a cell on an ``ny`` x ``nx`` grid."""
    return (t.cast("long") * ny + y) * nx + x


def cell_key(t: Column, y: Column, x: Column) -> Column:
    """Packed row-major key, see ``KEY_BITS``."""
    return (
        F.shiftleft(t.cast("long"), 2 * KEY_BITS)
        + F.shiftleft(y.cast("long"), KEY_BITS)
        + x.cast("long")
    )


def key_step(key: Column) -> Column:
    """Time step of a packed cell key."""
    return F.shiftright(key, 2 * KEY_BITS)
