"""Queries of the measuring operators: the sphere, the local plane, projective maps and rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.functions import geo
from meridian.operators import geometry, planes
from meridian.runtime import table

_GOOD = "latitude IS NOT NULL AND longitude IS NOT NULL AND NOT isnan(latitude) AND NOT isnan(longitude)"
_MAP = ("3.0 + p_size / 10.0", "0.2", "100.0 * p_partkey", "-0.1", "2.0 + p_size / 20.0", "50.0 * p_partkey", "0.0001", "0.00005 * (p_partkey % 7 - 3)", "1.0")


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "formations").where(_GOOD).select("formation_id", "latitude", "longitude", "coordinate_uncertainty_km").distinct()


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    pictures = table(spark, sf_dir, "commons_crop_circle_assertions").where(f"{_GOOD} AND matched_formation_id <> ''").select("commons_assertion_id", F.col("matched_formation_id").alias("formation_id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon")).distinct()
    return pictures.join(_placed(spark, sf_dir), "formation_id")


def _round(columns: dict, places: int) -> list:
    return [F.round(c, places).alias(n) for n, c in columns.items()]


def midpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The point halfway between each picture and its recorded formation, and their distance on the ground of the map plane."""
    lat, lon = geo.midpoint("latitude", "longitude", "lat", "lon")
    ground = geo.ground_distance(*geo.mercator("latitude", "longitude"), *geo.mercator("lat", "lon"))
    return _linked(spark, sf_dir).select("commons_assertion_id", "formation_id", *_round({"mid_lat": lat, "mid_lon": lon}, 6), F.round(ground, 3).alias("ground_m"))


def bearing_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each picture lies from due south of its formation, signed, and the sideways kilometres of two degrees there."""
    km, turn = geo.haversine_km("latitude", "longitude", "lat", "lon"), geo.bearing("latitude", "longitude", "lat", "lon")
    return _linked(spark, sf_dir).select("commons_assertion_id", "formation_id", F.round(geo.signed_difference(turn, F.lit(180.0)), 4).alias("off_south"), F.round(geo.lateral_uncertainty(km, F.lit(2.0)), 5).alias("sideways_km"))


def geodetic_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cartesian metres of each formation at 100 m on the ellipsoid, and the position again."""
    x, y, z = geo.cartesian("latitude", "longitude", F.lit(100.0), *geometry.WGS84)
    rows = _placed(spark, sf_dir).select("formation_id", x.alias("x"), y.alias("y"), z.alias("z"))
    lat, lon, height = geo.geodetic("x", "y", "z", *geometry.WGS84)
    return rows.select("formation_id", *_round({"x": F.col("x"), "y": F.col("y"), "z": F.col("z")}, 2), *_round({"lat": lat, "lon": lon}, 6), F.round(height, 3).alias("height"))


def pixel_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel (300, 200) of a picture centred on each formation, two metres a pixel and turned by its uncertainty."""
    lat, lon = geo.pixel_position(F.lit(300.0), F.lit(200.0), F.lit(128.0), F.lit(96.0), "latitude", "longitude", F.lit(2.0), F.coalesce("coordinate_uncertainty_km", F.lit(0.0)) * 10)
    return _placed(spark, sf_dir).select("formation_id", *_round({"lat": lat, "lon": lon}, 7)).distinct()


def turned_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners of a box of a hundredth of a degree about each formation, turned by 30 degrees, and its area on the sphere."""
    corners = geo.box_corners(F.col("latitude") + 0.005, F.col("latitude") - 0.005, F.col("longitude") + 0.005, F.col("longitude") - 0.005, F.lit(30.0))
    ring = F.array(*(F.struct(y.alias("lat"), x.alias("lon")) for y, x in corners))
    named = {f"{k}{i}": v for i, (y, x) in enumerate(corners) for k, v in (("lat", y), ("lon", x))}
    return _placed(spark, sf_dir).select("formation_id", *_round(named, 6), F.round(geo.spherical_area_km2(ring), 4).alias("km2")).distinct()


def raster_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of a pixel in north-up rasters sized from parts, bounds included."""
    k = F.col("p_partkey")
    width, height = F.col("p_size") * 60 + 200, F.col("p_size") * 40 + 300
    lat, lon = geo.raster_position(k % 200, k % 300, width, height, F.lit(-3.0), F.lit(50.0), F.lit(2.0), F.lit(54.0))
    return table(spark, sf_dir, "part").select("p_partkey", *_round({"lat": lat, "lon": lon}, 8))


def matrix_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverse of a map made from each part, its product with the map, and where it takes a point."""
    m = F.array(*(F.expr(f"CAST({e} AS double)") for e in _MAP))
    rows = table(spark, sf_dir, "part").select("p_partkey", m.alias("m")).withColumn("inv", planes.inverse(F.col("m")))
    one = planes.product(F.col("m"), F.col("inv"))
    u, v = geometry.apply_map(F.col("inv"), F.lit(1000.0), F.lit(500.0))
    return rows.select("p_partkey", F.round(F.get("inv", F.lit(0)) / F.get("inv", F.lit(8)), 6).alias("i11"), F.round(F.get(one, F.lit(0)) + F.get(one, F.lit(4)) + F.get(one, F.lit(8)), 6).alias("trace"), *_round({"u": u, "v": v}, 4))


def triangle_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The affine map of a triangle made from each order to another; none where the triangle is flat."""
    k = F.col("o_orderkey").cast("double")
    source = [(F.lit(0.0), F.lit(0.0)), (k % 13, k % 5), ((k % 7) * 2, k % 3)]
    target = [(k % 11, F.lit(1.0)), (k % 17, k % 4), (F.lit(5.0), k % 9)]
    m = planes.triangle_map(source, target)
    return table(spark, sf_dir, "orders").select("o_orderkey", *_round({n: F.get(m, F.lit(i)) for i, n in enumerate("acebdf")}, 6))


def point_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether four control points made from each order are fit for a map, or on a line or all in one place."""
    k = F.col("o_orderkey").cast("double")
    flat = planes.flatness([(k % 10, k % 10), (k % 3 * 5, k % 3 * 5), (k % 7, k % 7), (k % 4, (k % 4) + (k % 6) / 5 * (k % 2))])
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(flat, 8).alias("flatness"), (flat >= 1e-5).alias("fit"))


def raster_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """North-up rasters of at most 1,024 pixels for the footprints of maps made from parts; or why there is none."""
    m = F.array(*(F.expr(f"CAST({e} AS double)") for e in _MAP))
    corners, fault = planes.footprint(m, (F.col("p_size") * 400).cast("double"), (F.col("p_size") * 300).cast("double"))
    rows = table(spark, sf_dir, "part").select("p_partkey", corners.alias("corners"), fault.alias("fault")).withColumn("plan", planes.raster_plan(F.col("corners"), 1024))
    there = lambda c: F.when(F.col("fault").isNull(), F.col(f"plan.{c}"))
    return rows.select("p_partkey", "fault", there("width_px").alias("width_px"), there("height_px").alias("height_px"), *_round({c: there(c) for c in ("min_x", "min_y", "max_x", "max_y", "pixel_x", "pixel_y")}, 4))


def segment_bearings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bearings of a segment drawn in a picture at each formation, with the error of map, control points and clicks carried through."""
    x, y = geo.mercator("latitude", "longitude")
    turn = F.radians(F.pmod(F.abs(F.col("longitude")) * 17, F.lit(360.0)))
    m = F.array(F.cos(turn), F.sin(turn), x, F.sin(turn), -F.cos(turn), y, F.lit(0.0), F.lit(0.0), F.lit(1.0))
    far = (F.floor(F.abs("latitude")).cast("int") % 3 * 40).cast("double")
    rows = _placed(spark, sf_dir).select("formation_id", "latitude", "longitude", planes.segment_bearing(m, F.lit(0.0), F.lit(0.0), far, F.lit(0.0), F.lit(0.8), F.lit(0.5), F.lit(1.0)).alias("s")).distinct()
    return rows.select("formation_id", F.round("s.forward", 3).alias("forward"), F.round("s.reverse", 3).alias("reverse"), F.round("s.length_m", 3).alias("length_m"), F.round("s.uncertainty_deg", 4).alias("uncertainty_deg"), F.round("s.origin_m", 4).alias("origin_m"), F.round("s.lat", 5).alias("lat"))


def best_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each picture's own position or else its formation's, and the uncertainty in kilometres that goes with it."""
    formations = table(spark, sf_dir, "formations").groupBy(F.col("formation_id").alias("matched_formation_id")).agg(F.min(F.struct("latitude", "longitude", "coordinate_uncertainty_km")).alias("f"))
    pictures = table(spark, sf_dir, "commons_crop_circle_assertions").select("commons_assertion_id", "matched_formation_id", "latitude", "longitude", "match_distance_km").distinct()
    rows = pictures.join(formations, "matched_formation_id", "left")
    pair = F.coalesce(geo.valid_pair("latitude", "longitude"), geo.valid_pair("f.latitude", "f.longitude"))
    near = geo.uncertainty_km(F.lit(None).cast("double"), "match_distance_km")
    rows = rows.select("commons_assertion_id", "matched_formation_id", pair.alias("p"), near.alias("km"))
    return rows.select("commons_assertion_id", "matched_formation_id", F.round("p.lat", 6).alias("lat"), F.round("p.lon", 6).alias("lon"), F.when(F.col("km") == float("inf"), "unknown").when(F.col("km") <= 1, "near").otherwise("far").alias("reach")).distinct()


QUERIES = {f.__name__: f for f in (midpoints, bearing_errors, geodetic_roundtrip, pixel_positions, turned_boxes, raster_positions, matrix_algebra, triangle_maps, point_sets, raster_plans, segment_bearings, best_positions)}

_P = f"(SELECT DISTINCT formation_id, latitude, longitude, coordinate_uncertainty_km FROM formations WHERE {_GOOD})"
_L = f"(SELECT p.*, f.latitude, f.longitude FROM (SELECT DISTINCT commons_assertion_id, matched_formation_id AS formation_id, latitude lat, longitude lon FROM commons_crop_circle_assertions WHERE {_GOOD} AND matched_formation_id <> '') p JOIN {_P} f USING (formation_id))"
_HAV = "(2 * {4} * asin(sqrt(least(1.0, power(sin((radians({2}) - radians({0})) / 2), 2) + cos(radians({0})) * cos(radians({2})) * power(sin((radians({3}) - radians({1})) / 2), 2)))))".format
_BEAR = "((degrees(atan2(sin(radians({3}) - radians({1})) * cos(radians({2})), cos(radians({0})) * sin(radians({2})) - sin(radians({0})) * cos(radians({2})) * cos(radians({3}) - radians({1})))) + 360) % 360)".format
_MX, _MY = "(radians({}) * 6378137)".format, "(ln(tan(pi() / 4 + radians({}) / 2)) * 6378137)".format
_LAT, _LON = "degrees(2 * atan(exp(({}) / 6378137)) - pi() / 2)".format, "degrees(({}) / 6378137)".format
_CORNERS = [f"(latitude + ({a} * e * sin(t) + {b} * n * cos(t)) / 111320, longitude + ({a} * e * cos(t) - {b} * n * sin(t)) / w)" for a, b in ((-1, 1), (1, 1), (1, -1), (-1, -1))]
_M = ", ".join(f"({e})::double m{i}" for i, e in enumerate(_MAP))
SQL = {
    "midpoints": f"""WITH a AS (SELECT *, radians(latitude) y1, radians(lat) y2, radians(lon - longitude) t FROM {_L}), b AS (SELECT *, cos(y2) * cos(t) bx, cos(y2) * sin(t) by_ FROM a)
SELECT commons_assertion_id, formation_id, round(degrees(atan2(sin(y1) + sin(y2), sqrt(power(cos(y1) + bx, 2) + by_ * by_))), 6) AS mid_lat,
 round((longitude + degrees(atan2(by_, cos(y1) + bx)) + 540) % 360 - 180, 6) AS mid_lon, round({_HAV("latitude", "longitude", "lat", "lon", "6371008.8")}, 3) AS ground_m FROM b""",
    "bearing_errors": f"""SELECT commons_assertion_id, formation_id, round(({_BEAR("latitude", "longitude", "lat", "lon")} + 360) % 360 - 180, 4) AS off_south,
 round(abs(asin(sin({_HAV("latitude", "longitude", "lat", "lon", "6371.0088")} / 6371.0088) * sin(radians(2)))) * 6371.0088, 5) AS sideways_km FROM {_L}""",
    "geodetic_roundtrip": f"""WITH a AS (SELECT formation_id, latitude, longitude, 6378137.0 / sqrt(1 - 0.006694379990197619 * power(sin(radians(latitude)), 2)) v FROM {_P})
SELECT formation_id, round((v + 100) * cos(radians(latitude)) * cos(radians(longitude)), 2) AS x, round((v + 100) * cos(radians(latitude)) * sin(radians(longitude)), 2) AS y,
 round((v * (1 - 0.006694379990197619) + 100) * sin(radians(latitude)), 2) AS z, round(latitude, 6) AS lat, round(longitude, 6) AS lon, 100.0 AS height FROM a""",
    "pixel_positions": f"""WITH a AS (SELECT formation_id, latitude, longitude, radians(coalesce(coordinate_uncertainty_km, 0) * 10) t FROM {_P}),
b AS (SELECT *, 344 * sin(t) + 208 * sin(t + pi() / 2) e, 344 * cos(t) + 208 * cos(t + pi() / 2) n FROM a)
SELECT DISTINCT formation_id, round(latitude + n / 111320, 7) AS lat, round(longitude + e / (111320 * cos(radians(latitude))), 7) AS lon FROM b""",
    "turned_boxes": f"""WITH a AS (SELECT formation_id, latitude, longitude, radians(30) t, 111320 * cos(radians(latitude)) w FROM {_P}), b AS (SELECT *, 0.005 * w e, 0.005 * 111320 n FROM a),
c AS (SELECT formation_id, {", ".join(f"{p} AS p{i}" for i, p in enumerate(f"{{'lat': {c[1:-1].split(', ')[0]}, 'lon': {c[1:-1].split(', ')[1]}}}" for c in _CORNERS))} FROM b)
SELECT DISTINCT formation_id, {", ".join(f"round(p{i}.lat, 6) AS lat{i}, round(p{i}.lon, 6) AS lon{i}" for i in range(4))},
 round(abs({" + ".join(f"radians(p{(i + 1) % 4}.lon - p{i}.lon) * (2 + sin(radians(p{i}.lat)) + sin(radians(p{(i + 1) % 4}.lat)))" for i in range(4))}) * 6371.0088 * 6371.0088 / 2, 4) AS km2 FROM c""",
    "raster_positions": "SELECT p_partkey, round(54.0 - 4.0 * (p_partkey % 300) / (p_size * 40 + 300), 8) AS lat, round(-3.0 + 5.0 * (p_partkey % 200) / (p_size * 60 + 200), 8) AS lon FROM part",
    "matrix_algebra": f"""WITH m AS (SELECT p_partkey, {_M} FROM part), d AS (SELECT *, m4 * m8 - m5 * m7 A, m2 * m7 - m1 * m8 B, m1 * m5 - m2 * m4 C, m5 * m6 - m3 * m8 D, m0 * m8 - m2 * m6 E, m2 * m3 - m0 * m5 F, m3 * m7 - m4 * m6 G, m1 * m6 - m0 * m7 H, m0 * m4 - m1 * m3 I FROM m)
SELECT p_partkey, round(A / I, 6) AS i11, 3.0 AS trace, round((A * 1000 + B * 500 + C) / (G * 1000 + H * 500 + I), 4) AS u, round((D * 1000 + E * 500 + F) / (G * 1000 + H * 500 + I), 4) AS v FROM d""",
    "triangle_maps": """WITH k AS (SELECT o_orderkey, (o_orderkey % 13)::double x1, (o_orderkey % 5)::double y1, (o_orderkey % 7 * 2)::double x2, (o_orderkey % 3)::double y2, (o_orderkey % 11)::double u0, 1.0::double v0, (o_orderkey % 17)::double u1, (o_orderkey % 4)::double v1, 5.0::double u2, (o_orderkey % 9)::double v2 FROM orders),
d AS (SELECT *, x1 * y2 - x2 * y1 det FROM k), s AS (SELECT *, ((u1 - u0) * y2 - (u2 - u0) * y1) / nullif(det, 0) a, (x1 * (u2 - u0) - x2 * (u1 - u0)) / nullif(det, 0) c, ((v1 - v0) * y2 - (v2 - v0) * y1) / nullif(det, 0) b, (x1 * (v2 - v0) - x2 * (v1 - v0)) / nullif(det, 0) d2 FROM d)
SELECT o_orderkey, round(a, 6) AS a, round(c, 6) AS c, round(CASE WHEN det <> 0 THEN u0 END, 6) AS e, round(b, 6) AS b, round(d2, 6) AS d, round(CASE WHEN det <> 0 THEN v0 END, 6) AS f FROM s""",
    "point_sets": """WITH k AS (SELECT o_orderkey, [{'x': (o_orderkey % 10)::double, 'y': (o_orderkey % 10)::double}, {'x': (o_orderkey % 3 * 5)::double, 'y': (o_orderkey % 3 * 5)::double}, {'x': (o_orderkey % 7)::double, 'y': (o_orderkey % 7)::double}, {'x': (o_orderkey % 4)::double, 'y': (o_orderkey % 4) + (o_orderkey % 6) / 5.0 * (o_orderkey % 2)}] p FROM orders),
t AS (SELECT o_orderkey, p, unnest([[1, 2, 3], [1, 2, 4], [1, 3, 4], [2, 3, 4]]) i FROM k), a AS (SELECT o_orderkey, any_value(p) p, max(abs((p[i[2]].x - p[i[1]].x) * (p[i[3]].y - p[i[1]].y) - (p[i[2]].y - p[i[1]].y) * (p[i[3]].x - p[i[1]].x)) / 2) area FROM t GROUP BY 1),
b AS (SELECT o_orderkey, area, power(greatest(p[1].x, p[2].x, p[3].x, p[4].x) - least(p[1].x, p[2].x, p[3].x, p[4].x), 2) + power(greatest(p[1].y, p[2].y, p[3].y, p[4].y) - least(p[1].y, p[2].y, p[3].y, p[4].y), 2) box FROM a)
SELECT o_orderkey, round(CASE WHEN box > 1e-12 THEN area / box ELSE 0 END, 8) AS flatness, (CASE WHEN box > 1e-12 THEN area / box ELSE 0 END) >= 1e-5 AS fit FROM b""",
    "raster_plans": f"""WITH m AS (SELECT p_partkey, (p_size * 400)::double w, (p_size * 300)::double h, {_M} FROM part), c AS (SELECT *, unnest([1, 2, 3, 4]) i FROM m), p AS (SELECT *, CASE WHEN i IN (2, 3) THEN w ELSE 0 END x, CASE WHEN i IN (3, 4) THEN h ELSE 0 END y FROM c),
q AS (SELECT *, m6 * x + m7 * y + m8 AS d FROM p), r AS (SELECT *, (m0 * x + m1 * y + m2) / d u, (m3 * x + m4 * y + m5) / d v FROM q),
g AS (SELECT p_partkey, min(d) * max(d) < 0 OR min(abs(d)) < 1e-12 AS horizon, min(u) west, max(u) east, min(v) south, max(v) north, list(u ORDER BY i) us, list(v ORDER BY i) vs FROM r GROUP BY 1),
z AS (SELECT *, [(us[j % 4 + 1] - us[j]) * (vs[(j + 1) % 4 + 1] - vs[j % 4 + 1]) - (vs[j % 4 + 1] - vs[j]) * (us[(j + 1) % 4 + 1] - us[j % 4 + 1]) for j in [1, 2, 3, 4]] AS turns FROM g),
f AS (SELECT *, CASE WHEN horizon THEN 'horizon' WHEN NOT list_min(turns) * list_max(turns) > 0 THEN 'folded' END AS fault FROM z),
s AS (SELECT p_partkey, fault, CASE WHEN fault IS NULL THEN west END AS min_x, CASE WHEN fault IS NULL THEN south END AS min_y, CASE WHEN fault IS NULL THEN east END AS max_x, CASE WHEN fault IS NULL THEN north END AS max_y FROM f),
t AS (SELECT *, CASE WHEN max_x - min_x >= max_y - min_y THEN 1024 WHEN fault IS NULL THEN greatest(1, round_even((max_x - min_x) / (max_y - min_y) * 1024, 0)::int) END AS width_px, CASE WHEN max_x - min_x >= max_y - min_y THEN greatest(1, round_even((max_y - min_y) / (max_x - min_x) * 1024, 0)::int) WHEN fault IS NULL THEN 1024 END AS height_px FROM s)
SELECT p_partkey, fault, width_px, height_px, round(min_x, 4) AS min_x, round(min_y, 4) AS min_y, round(max_x, 4) AS max_x, round(max_y, 4) AS max_y, round((max_x - min_x) / width_px, 4) AS pixel_x, round((max_y - min_y) / height_px, 4) AS pixel_y FROM t""",
    "segment_bearings": f"""WITH a AS (SELECT DISTINCT formation_id, latitude, longitude, {_MX("longitude")} x, {_MY("latitude")} y, radians((abs(longitude) * 17) % 360) t, (floor(abs(latitude))::int % 3 * 40)::double far FROM {_P}),
b AS (SELECT *, {_LAT("y + sin(t) * far")} la, {_LON("x + cos(t) * far")} lo, {_LAT("y + sin(t)")} h1a, {_LON("x + cos(t)")} h1o, {_LAT("y - cos(t)")} v1a, {_LON("x + sin(t)")} v1o, {_LAT("y + sin(t) * (far + 1)")} h2a, {_LON("x + cos(t) * (far + 1)")} h2o, {_LAT("y + sin(t) * far - cos(t)")} v2a, {_LON("x + cos(t) * far + sin(t)")} v2o FROM a),
c AS (SELECT *, {_HAV("latitude", "longitude", "la", "lo", "6371008.8")} len, sqrt(0.89 + (power({_HAV("latitude", "longitude", "h1a", "h1o", "6371008.8")}, 2) + power({_HAV("latitude", "longitude", "v1a", "v1o", "6371008.8")}, 2)) / 2) s1, sqrt(0.89 + (power({_HAV("la", "lo", "h2a", "h2o", "6371008.8")}, 2) + power({_HAV("la", "lo", "v2a", "v2o", "6371008.8")}, 2)) / 2) s2 FROM b),
d AS (SELECT *, len >= 0.01 AS long FROM c)
SELECT formation_id, CASE WHEN long THEN round({_BEAR("latitude", "longitude", "la", "lo")}, 3) END AS forward, CASE WHEN long THEN round({_BEAR("la", "lo", "latitude", "longitude")}, 3) END AS reverse, CASE WHEN long THEN round(len, 3) END AS length_m,
 CASE WHEN long THEN round(least(180, degrees(atan2(sqrt(s1 * s1 + s2 * s2), len))), 4) END AS uncertainty_deg, CASE WHEN long THEN round(greatest(s1, s2), 4) END AS origin_m, CASE WHEN long THEN round((latitude + la) / 2, 5) END AS lat FROM d""",
    "best_positions": """WITH f AS (SELECT formation_id, min({'a': latitude, 'b': longitude, 'c': coordinate_uncertainty_km}) f FROM formations GROUP BY 1), p AS (SELECT DISTINCT commons_assertion_id, matched_formation_id, latitude, longitude, match_distance_km d FROM commons_crop_circle_assertions),
j AS (SELECT p.*, abs(latitude) <= 90 AND abs(longitude) <= 180 AS own, CASE WHEN abs(f.a) <= 90 AND abs(f.b) <= 180 THEN f.a END fa, CASE WHEN abs(f.a) <= 90 AND abs(f.b) <= 180 THEN f.b END fb FROM p LEFT JOIN f ON f.formation_id = p.matched_formation_id)
SELECT DISTINCT commons_assertion_id, matched_formation_id, round(CASE WHEN coalesce(own, false) THEN latitude ELSE fa END, 6) AS lat, round(CASE WHEN coalesce(own, false) THEN longitude ELSE fb END, 6) AS lon, CASE WHEN d IS NULL OR isnan(d) OR d <= 0 THEN 'unknown' WHEN d <= 1 THEN 'near' ELSE 'far' END AS reach FROM j""",
}
