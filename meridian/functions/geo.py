"""Geodesy as column expressions; degrees in, degrees, metres or kilometres out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sphere radii of the several models, and the metres of a degree on the local plane.
KM_RADIUS = 6371.0088
DUPLICATE_RADIUS_M = 6_371_000.0
REGISTRATION_RADIUS_M = 6_371_008.8
MERCATOR_RADIUS_M = 6_378_137.0
MERCATOR_MAX_LATITUDE = 85.0511287798066
DEGREE_M = 111_320.0


def _c(x: str | float | Column) -> Column:
    return F.col(x) if isinstance(x, str) else F.lit(x) if isinstance(x, (int, float)) else x


def _unit(x: Column) -> Column:
    """``x`` within [-1, 1]; null stays null, which least() and greatest() would pass over."""
    return F.when(x > 1, F.lit(1.0)).when(x < -1, F.lit(-1.0)).otherwise(x)


def haversine(lat1, lon1, lat2, lon2, radius: float) -> Column:
    """Great-circle distance in the unit of ``radius``; null where any input is null."""
    lat1, lon1, lat2, lon2 = (F.radians(_c(v)) for v in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    return F.lit(2 * radius) * F.asin(F.sqrt(F.when(h > 1, F.lit(1.0)).otherwise(h)))


def haversine_m(lat1, lon1, lat2, lon2, radius: float = DUPLICATE_RADIUS_M) -> Column:
    return haversine(lat1, lon1, lat2, lon2, radius)


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    return haversine(lat1, lon1, lat2, lon2, KM_RADIUS)


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing in [0, 360)."""
    lat1, lon1, lat2, lon2 = (F.radians(_c(v)) for v in (lat1, lon1, lat2, lon2))
    y = F.sin(lon2 - lon1) * F.cos(lat2)
    x = F.cos(lat1) * F.sin(lat2) - F.sin(lat1) * F.cos(lat2) * F.cos(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def destination(lat, lon, azimuth, km) -> tuple[Column, Column]:
    """(latitude, longitude in [-180, 180)) after ``km`` along a great circle."""
    lat, lon, azimuth, d = F.radians(_c(lat)), F.radians(_c(lon)), F.radians(_c(azimuth)), _c(km) / KM_RADIUS
    s = F.sin(lat) * F.cos(d) + F.cos(lat) * F.sin(d) * F.cos(azimuth)
    to = F.asin(_unit(s))
    east = lon + F.atan2(F.sin(azimuth) * F.sin(d) * F.cos(lat), F.cos(d) - F.sin(lat) * F.sin(to))
    return F.degrees(to), F.pmod(F.degrees(east) + 540.0, F.lit(360.0)) - 180.0


def track(lat, lon, azimuth, lat2, lon2) -> tuple[Column, Column]:
    """(along, cross) kilometres of a target against the great circle from a start at an azimuth."""
    d = haversine_km(lat, lon, lat2, lon2) / KM_RADIUS
    turn = F.radians(bearing(lat, lon, lat2, lon2)) - F.radians(_c(azimuth))
    cross = F.asin(_unit(F.sin(d) * F.sin(turn)))
    along = F.atan2(F.sin(d) * F.cos(turn), F.cos(d))
    return along * KM_RADIUS, cross * KM_RADIUS


def axis_difference(a, b, period: float = 360.0) -> Column:
    """Smallest absolute difference of two angles of a period."""
    half = period / 2
    return F.abs(F.pmod(_c(a) - _c(b) + half, F.lit(period)) - half)


def mercator(lat, lon) -> tuple[Column, Column]:
    """(x, y) metres of spherical Web Mercator, the latitude clamped."""
    lat = F.greatest(F.lit(-MERCATOR_MAX_LATITUDE), F.least(F.lit(MERCATOR_MAX_LATITUDE), _c(lat)))
    return F.radians(_c(lon)) * MERCATOR_RADIUS_M, F.log(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2)) * MERCATOR_RADIUS_M


def unmercator(x, y) -> tuple[Column, Column]:
    """(latitude, longitude) of Web Mercator metres."""
    return F.degrees(2 * F.atan(F.exp(_c(y) / MERCATOR_RADIUS_M)) - 1.5707963267948966), F.degrees(_c(x) / MERCATOR_RADIUS_M)


def lateral_uncertainty(km, degrees) -> Column:
    """Greatest sideways kilometres at a distance along a great circle whose bearing may be off by ``degrees``."""
    return F.abs(F.asin(_unit(F.sin(_c(km) / KM_RADIUS) * F.sin(F.radians(_c(degrees)))))) * KM_RADIUS


def signed_difference(a, b) -> Column:
    """How far angle a lies from angle b, in [-180, 180)."""
    return F.pmod(_c(a) - _c(b) + 180.0, F.lit(360.0)) - 180.0


def midpoint(lat1, lon1, lat2, lon2) -> tuple[Column, Column]:
    """(latitude, longitude in [-180, 180)) halfway along the great circle between two points."""
    y1, y2, turn = F.radians(_c(lat1)), F.radians(_c(lat2)), F.radians(_c(lon2) - _c(lon1))
    bx, by = F.cos(y2) * F.cos(turn), F.cos(y2) * F.sin(turn)
    lat = F.atan2(F.sin(y1) + F.sin(y2), F.sqrt((F.cos(y1) + bx) ** 2 + by**2))
    return F.degrees(lat), F.pmod(_c(lon1) + F.degrees(F.atan2(by, F.cos(y1) + bx)) + 540.0, F.lit(360.0)) - 180.0


def ground_distance(x1, y1, x2, y2, radius: float = REGISTRATION_RADIUS_M) -> Column:
    """Metres on the ground between two points given in Web Mercator metres."""
    (lat1, lon1), (lat2, lon2) = unmercator(x1, y1), unmercator(x2, y2)
    return haversine(lat1, lon1, lat2, lon2, radius)


def cartesian(lat, lon, height, a: float, b: float) -> tuple[Column, Column, Column]:
    """(x, y, z) metres of a geodetic position on an ellipsoid of semi-axes a and b."""
    y, x, h, e2 = F.radians(_c(lat)), F.radians(_c(lon)), _c(height), 1 - b * b / (a * a)
    v = F.lit(a) / F.sqrt(1 - e2 * F.sin(y) ** 2)
    return (v + h) * F.cos(y) * F.cos(x), (v + h) * F.cos(y) * F.sin(x), (v * (1 - e2) + h) * F.sin(y)


def geodetic(x, y, z, a: float, b: float) -> tuple[Column, Column, Column]:
    """(latitude, longitude, height) of cartesian metres by the closed form, good to a ten-millionth of a metre near the surface."""
    x, y, z = _c(x), _c(y), _c(z)
    e2, f2 = 1 - b * b / (a * a), a * a / (b * b) - 1
    p = F.sqrt(x**2 + y**2)
    t = F.atan2(z * a, p * b)
    lat = F.atan2(z + F.lit(f2 * b) * F.sin(t) ** 3, p - F.lit(e2 * a) * F.cos(t) ** 3)
    return F.degrees(lat), F.degrees(F.atan2(y, x)), p * F.cos(lat) + z * F.sin(lat) - F.lit(a) * F.sqrt(1 - e2 * F.sin(lat) ** 2)


def pixel_position(x, y, anchor_x, anchor_y, lat, lon, scale, bearing, turn=90.0) -> tuple[Column, Column]:
    """(latitude, longitude) of a pixel on the local plane of an anchor: ``scale`` metres a pixel, the x axis at ``bearing``, the y axis ``turn`` degrees on."""
    right, down = (_c(x) - _c(anchor_x)) * _c(scale), (_c(y) - _c(anchor_y)) * _c(scale)
    along, across = F.radians(_c(bearing)), F.radians(_c(bearing) + _c(turn))
    east, north = F.sin(along) * right + F.sin(across) * down, F.cos(along) * right + F.cos(across) * down
    return _c(lat) + north / DEGREE_M, _c(lon) + east / (F.cos(F.radians(_c(lat))) * DEGREE_M)


def box_corners(north, south, east, west, turn=0.0) -> list[tuple[Column, Column]]:
    """(latitude, longitude) of a box's four corners from the upper left clockwise, turned counter-clockwise about its centre on the local plane."""
    lat, lon, t = (_c(north) + _c(south)) / 2, (_c(east) + _c(west)) / 2, F.radians(_c(turn))
    wide = F.cos(F.radians(lat)) * DEGREE_M
    e, n = (_c(east) - _c(west)) * wide / 2, (_c(north) - _c(south)) * DEGREE_M / 2
    return [(lat + (a * e * F.sin(t) + b * n * F.cos(t)) / DEGREE_M, lon + (a * e * F.cos(t) - b * n * F.sin(t)) / wide) for a, b in ((-1, 1), (1, 1), (1, -1), (-1, -1))]


def raster_position(x, y, width, height, west, south, east, north) -> tuple[Column, Column]:
    """(latitude, longitude) of a pixel of a north-up raster, by interpolation between its bounds."""
    return _c(north) + (_c(south) - _c(north)) * _c(y) / _c(height), _c(west) + (_c(east) - _c(west)) * _c(x) / _c(width)


def spherical_area_km2(ring: Column, radius: float = KM_RADIUS) -> Column:
    """Area of an array of (lat, lon) structs, in order, not closed, on a sphere; edges between points are taken straight in longitude and the sine of latitude."""
    nxt = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    part = F.zip_with(ring, nxt, lambda p, q: F.radians(q["lon"] - p["lon"]) * (2 + F.sin(F.radians(p["lat"])) + F.sin(F.radians(q["lat"]))))
    return F.abs(F.aggregate(part, F.lit(0.0), lambda s, v: s + v)) * (radius * radius / 2)


def valid_pair(lat, lon) -> Column:
    """(lat, lon) as a struct where both are finite and in range, else null."""
    y, x = _c(lat).try_cast("double"), _c(lon).try_cast("double")
    return F.when(~F.isnan(y) & ~F.isnan(x) & (F.abs(y) <= 90) & (F.abs(x) <= 180), F.struct(y.alias("lat"), x.alias("lon")))


def uncertainty_km(metres, km) -> Column:
    """Kilometres from the column in metres, else that in kilometres, else infinity; nought and less count as missing."""
    m, k = _c(metres).try_cast("double"), _c(km).try_cast("double")
    return F.coalesce(F.when((m > 0) & ~F.isnan(m), m / 1000), F.when((k > 0) & ~F.isnan(k), k), F.lit(float("inf")))
