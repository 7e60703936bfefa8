"""Geometry as column expressions: distances, zones, grid names, raster indices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: mean radius (2a + b) / 3 of the WGS84 ellipsoid, in metres.
EARTH_RADIUS_M = 6371008.7714


def haversine_term(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """sin^2 of half the central angle: monotone in distance, cheaper to compare."""
    half_dlat = F.sin(F.radians(lat2 - lat1) / 2)
    half_dlon = F.sin(F.radians(lon2 - lon1) / 2)
    return half_dlat * half_dlat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_dlon * half_dlon


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres on the mean sphere."""
    h = haversine_term(lon1, lat1, lon2, lat2)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def utm_epsg(lon: Column, lat: Column) -> Column:
    """EPSG code of the UTM zone holding a point, as 'epsg:326NN' or 'epsg:327NN'."""
    zone = F.pmod(F.floor((lon + 180) / 6), F.lit(60)) + 1
    hemisphere = F.when(lat >= 0, "326").otherwise("327")
    return F.concat(F.lit("epsg:"), hemisphere, F.lpad(zone.cast("string"), 2, "0"))


def geo_partition(lon: Column, lat: Column, buckets: int = 1000) -> Column:
    """Pseudo-random bucket of the 2 x 2 degree cell of a point (truncated toward zero)."""
    cell = (lon / 2).cast("int") * 360 + (lat / 2).cast("int")
    return F.pmod(F.hash(cell), F.lit(buckets))


def hemisphere_label(value: Column, positive: str, negative: str) -> Column:
    """Letter of the hemisphere and absolute whole degrees, as in 'N5' or 'W60'."""
    letter = F.when(value < 0, negative).otherwise(positive)
    return F.concat(letter, F.abs(value).cast("int").cast("string"))


def corner_name(left: Column, top: Column) -> Column:
    """Tile name from its top left corner, as in 'N5_W60'."""
    return F.concat(hemisphere_label(top, "N", "S"), F.lit("_"), hemisphere_label(left, "E", "W"))


# ----- raster indices ---------------------------------------------------------------
# An axis is (x0, dx, n): coordinate of entry 0, signed step, length. ``anchor`` says
# whether coordinates name the low edge of a pixel or its centre. All arithmetic is done
# in index space, so descending axes need no special case.


def _position(v: Column, x0: Column, dx: Column, anchor: str) -> Column:
    """Fractional index measured from the low edge of pixel 0."""
    if anchor not in ("edge", "centre"):
        raise ValueError("anchor must be 'edge' or 'centre'")
    u = (v - x0) / dx
    return u if anchor == "edge" else u + 0.5


def nearest_index(v: Column, x0: Column, dx: Column, n: Column, anchor: str = "centre") -> Column:
    """Index of the pixel whose centre is nearest; lower index on ties; clamped to the axis."""
    i = F.ceil(_position(v, x0, dx, anchor)) - 1
    return F.greatest(F.lit(0).cast("long"), F.least(n.cast("long") - 1, i))


def two_nearest(v: Column, x0: Column, dx: Column, n: Column, anchor: str = "edge") -> tuple[Column, Column]:
    """Nearest pixel and the neighbour on the value's side.

    The first index is clamped to the axis, the second is not: a value at or beyond the
    border yields a second index outside the raster.
    """
    u = _position(v, x0, dx, anchor)
    near = nearest_index(v, x0, dx, n, anchor)
    side = F.when(u < near + 0.5, F.lit(-1)).otherwise(F.lit(1))
    return near, near + side


def two_nearest_index(v: Column, x0: Column, dx: Column, n: Column, anchor: str = "edge") -> Column:
    """``two_nearest`` as one array<bigint> column."""
    return F.array(*two_nearest(v, x0, dx, n, anchor))


def floor_index(v: Column, x0: Column, dx: Column) -> Column:
    """Index of the pixel holding a value, for regular edge-anchored axes; not clamped."""
    return F.floor((v - x0) / dx)


# ----- WKB --------------------------------------------------------------------------


def swap_bytes(hex_text: Column, size: int) -> Column:
    """Hex text of ``size`` bytes in reverse byte order."""
    return F.concat(*[F.substring(hex_text, 1 + 2 * (size - 1 - b), 2) for b in range(size)])


def double_from_bits(head: Column, mantissa: Column) -> Column:
    """IEEE-754 double from its sign and exponent (12 bits) and its mantissa (52 bits).

    Every step is exact. Infinities and NaN, which an empty point carries, become NULL.
    """
    exponent = head.bitwiseAND(2047)
    fraction = mantissa / float(2**52)
    sign = F.when(head >= 2048, F.lit(-1.0)).otherwise(F.lit(1.0))
    size = F.pow(F.lit(2.0), F.greatest(exponent, F.lit(1)) - 1023)
    return F.when(exponent < 2047, sign * size * (fraction + F.when(exponent == 0, 0.0).otherwise(1.0)))
