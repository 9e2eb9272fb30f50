"""Projective maps of the plane as arrays of nine numbers by rows: products, inverses, footprints, raster plans, bearings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from meridian.functions import geo
from meridian.operators.geometry import apply_map, convex

#: Denominators and determinants below this count as nought.
EPSILON = 1e-12


def _at(m: Column, i: int) -> Column:
    return F.get(m, F.lit(i))


def product(a: Column, b: Column) -> Column:
    """The map that applies ``b`` and then ``a``."""
    return F.array(*(sum((_at(a, 3 * r + k) * _at(b, 3 * k + c) for k in range(1, 3)), _at(a, 3 * r) * _at(b, c)) for r in range(3) for c in range(3)))


def inverse(m: Column) -> Column:
    """The inverse map; null where there is none."""
    a, b, c, d, e, f, g, h, i = (_at(m, k) for k in range(9))
    parts = [e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d]
    det = a * parts[0] + b * parts[3] + c * parts[6]
    return F.when(F.abs(det) >= EPSILON, F.array(*(p / det for p in parts)))


def triangle_map(source: Sequence[tuple[Column, Column]], target: Sequence[tuple[Column, Column]]) -> Column:
    """The affine map of three points to three others, nine numbers by rows; null where the three lie on a line."""
    (x0, y0), (x1, y1), (x2, y2) = source
    det = x0 * (y1 - y2) + x1 * (y2 - y0) + x2 * (y0 - y1)

    def row(v0: Column, v1: Column, v2: Column) -> list[Column]:
        return [
            (v0 * (y1 - y2) + v1 * (y2 - y0) + v2 * (y0 - y1)) / det,
            (v0 * (x2 - x1) + v1 * (x0 - x2) + v2 * (x1 - x0)) / det,
            (v0 * (x1 * y2 - x2 * y1) + v1 * (x2 * y0 - x0 * y2) + v2 * (x0 * y1 - x1 * y0)) / det,
        ]

    us, vs = zip(*target)
    return F.when(F.abs(det) > EPSILON, F.array(*row(*us), *row(*vs), F.lit(0.0), F.lit(0.0), F.lit(1.0)))


def flatness(points: Sequence[tuple[Column, Column]]) -> Column:
    """The largest triangle of a few points over the square of their box's diagonal; nought where they are one point."""
    n = len(points)
    area = [F.abs((points[j][0] - points[i][0]) * (points[k][1] - points[i][1]) - (points[j][1] - points[i][1]) * (points[k][0] - points[i][0])) / 2 for i in range(n) for j in range(i + 1, n) for k in range(j + 1, n)]
    xs, ys = zip(*points)
    box = (F.greatest(*xs) - F.least(*xs)) ** 2 + (F.greatest(*ys) - F.least(*ys)) ** 2
    return F.coalesce(F.when(box > EPSILON, F.greatest(*area) / box), F.lit(0.0))


def footprint(m: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """(corners, fault) of an image under a map: four (x, y) structs from the first pixel on; fault is horizon, folded or null."""
    zero = F.lit(0.0)
    image = [(zero, zero), (width, zero), (width, height), (zero, height)]
    below = [_at(m, 6) * x + _at(m, 7) * y + _at(m, 8) for x, y in image]
    horizon = (F.least(*map(F.abs, below)) < EPSILON) | (F.least(*below) * F.greatest(*below) < 0)
    mapped = [apply_map(m, x, y) for x, y in image]
    folded = ~convex([u for u, _ in mapped], [v for _, v in mapped])
    fault = F.when(horizon, "horizon").when(folded, "folded")
    return F.when(fault.isNull(), F.array(*(F.struct(u.alias("x"), v.alias("y")) for u, v in mapped))), fault


def raster_plan(corners: Column, longest: int) -> Column:
    """Size and bounds of the north-up raster that holds a footprint: width_px, height_px, min_x, min_y, max_x, max_y, pixel_x, pixel_y."""
    xs, ys = corners["x"], corners["y"]
    west, east, south, north = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    wide = east - west >= north - south
    across = F.when(wide, F.lit(longest)).otherwise(F.greatest(F.lit(1), F.rint((east - west) / (north - south) * longest).cast("int")))
    down = F.when(wide, F.greatest(F.lit(1), F.rint((north - south) / (east - west) * longest).cast("int"))).otherwise(F.lit(longest))
    return F.struct(across.alias("width_px"), down.alias("height_px"), west.alias("min_x"), south.alias("min_y"), east.alias("max_x"), north.alias("max_y"), ((east - west) / across).alias("pixel_x"), ((north - south) / down).alias("pixel_y"))


def metres_a_pixel(m: Column, x: Column, y: Column) -> Column:
    """Ground metres that one pixel's step covers at a point, the root mean square of both directions."""
    here, right, down = (apply_map(m, x + dx, y + dy) for dx, dy in ((0, 0), (1, 0), (0, 1)))
    return F.sqrt((geo.ground_distance(*here, *right) ** 2 + geo.ground_distance(*here, *down) ** 2) / 2)


def segment_bearing(m: Column, ax: Column, ay: Column, bx: Column, by: Column, rmse: Column, control: Column, click: Column) -> Column:
    """Bearings and their uncertainty of a segment drawn in an image: forward, reverse, length_m, uncertainty_deg, origin_m, lat, lon.

    Null where its ends are within a centimetre. An end is off by the map's error, the control
    points' and the click's together; the bearing by both ends' across the segment's length.
    """
    a, b = apply_map(m, ax, ay), apply_map(m, bx, by)
    (lat1, lon1), (lat2, lon2) = geo.unmercator(*a), geo.unmercator(*b)
    length = geo.haversine(lat1, lon1, lat2, lon2, geo.REGISTRATION_RADIUS_M)
    base = rmse**2 + control**2
    off = [F.sqrt(base + (metres_a_pixel(m, x, y) * click) ** 2) for x, y in ((ax, ay), (bx, by))]
    lat, lon = geo.midpoint(lat1, lon1, lat2, lon2)
    fields = {
        "forward": geo.bearing(lat1, lon1, lat2, lon2), "reverse": geo.bearing(lat2, lon2, lat1, lon1), "length_m": length,
        "uncertainty_deg": F.least(F.lit(180.0), F.degrees(F.atan2(F.sqrt(off[0] ** 2 + off[1] ** 2), length))), "origin_m": F.greatest(*off), "lat": lat, "lon": lon,
    }
    return F.when(length >= 0.01, F.struct(*(v.alias(k) for k, v in fields.items())))
