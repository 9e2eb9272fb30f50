"""Queries of the geodetic, geometric, vector and graph operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.functions import geo
from meridian.operators import analytics, geometry, graph, match
from meridian.operators.proximity import regions_of
from meridian.runtime import table

# Boxes of countries as (code, west, south, east, north).
BOXES = [("GB", -8.7, 49.8, 1.8, 60.9), ("US", -125.0, 24.4, -66.9, 49.4), ("DE", 5.8, 47.2, 15.1, 55.1), ("FR", -5.2, 42.3, 8.3, 51.2), ("NL", 3.3, 50.7, 7.3, 53.6), ("IT", 6.6, 36.6, 18.6, 47.1), ("AU", 112.9, -43.7, 153.7, -10.6)]


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "formations").where("latitude IS NOT NULL AND longitude IS NOT NULL AND NOT isnan(latitude) AND NOT isnan(longitude)")
    return rows.select("formation_id", "latitude", "longitude", "country_code").distinct()


def _pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "commons_crop_circle_assertions").where("latitude IS NOT NULL AND longitude IS NOT NULL AND matched_formation_id <> ''")
    return rows.select("commons_assertion_id", F.col("matched_formation_id").alias("formation_id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon")).distinct()


def geo_haversine_bearing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance and bearing from each picture's recorded formation to the picture."""
    rows = _pictures(spark, sf_dir).join(_placed(spark, sf_dir), "formation_id")
    km, turn = geo.haversine_km("latitude", "longitude", "lat", "lon"), geo.bearing("latitude", "longitude", "lat", "lon")
    return rows.select("commons_assertion_id", "formation_id", F.round(km, 5).alias("km"), F.round(turn, 4).alias("bearing"))


def geo_destination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 100 km towards 45 degrees lead from each formation."""
    lat, lon = geo.destination("latitude", "longitude", F.lit(45.0), F.lit(100.0))
    return _placed(spark, sf_dir).select("formation_id", F.round(lat, 6).alias("to_lat"), F.round(lon, 6).alias("to_lon"))


def mercator_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web Mercator metres of each formation, and back."""
    rows = _placed(spark, sf_dir).withColumns(dict(zip(("x", "y"), geo.mercator("latitude", "longitude"))))
    lat, lon = geo.unmercator("x", "y")
    return rows.select("formation_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


def country_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formations of boxed countries, and how many lie in their country's box."""
    boxes = spark.createDataFrame(BOXES, "country_code string, west double, south double, east double, north double")
    rows = _placed(spark, sf_dir).join(F.broadcast(boxes), "country_code")  # a list of a few rows
    inside = F.col("longitude").between(F.col("west"), F.col("east")) & F.col("latitude").between(F.col("south"), F.col("north"))
    return rows.groupBy("country_code").agg(F.count("*").alias("placed"), F.count_if(inside).alias("inside"))


def region_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box that each placemark lies in, borders included, through triangles and their hierarchy."""
    corner = lambda x, y: f"named_struct('x', {x}, 'y', {y})"
    ring = F.expr(f"array({corner('west', 'south')}, {corner('east', 'south')}, {corner('east', 'north')}, {corner('west', 'north')})")
    boxes = spark.createDataFrame(BOXES, "region_code string, west double, south double, east double, north double").select("region_code", ring.alias("ring"))
    marks = table(spark, sf_dir, "legacy_kml_candidate_queue").select("legacy_candidate_id", "latitude", "longitude").distinct()
    return regions_of(marks, "longitude", "latitude", boxes, "region_code", "ring", "region").select("legacy_candidate_id", "region")


def corridor_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placed formations within 10 km of rays of 300 km from each placed formation, their azimuths made from the ids."""
    placed = _placed(spark, sf_dir)
    turn = (F.conv(F.substring("formation_id", 4, 4), 16, 10).cast("int") % 360).cast("double")
    rays = placed.select(F.col("formation_id").alias("ray_id"), F.col("latitude").alias("ray_lat"), F.col("longitude").alias("ray_lon"), turn.alias("azimuth"), F.lit(300.0).alias("range_km"), F.lit(10.0).alias("corridor_km"))
    sites = placed.select(F.col("formation_id").alias("site_id"), F.col("latitude").alias("site_lat"), F.col("longitude").alias("site_lon"))
    return match.corridor_join(rays, sites, "ray_id", "site_id", 0.125).select("ray_id", "site_id", *(F.round(c, 4).alias(c) for c in ("distance_km", "along_km", "cross_km")))


def topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar vectors of every twentieth vector."""
    rows = table(spark, sf_dir, "embeddings")
    return match.nearest_vectors(rows, "vec_id", "embedding", rows.where("vec_id % 20 = 0"), 5)


def ratio_test_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors that are clearly nearer than the second nearest."""
    rows = table(spark, sf_dir, "embeddings")
    top = match.nearest_vectors(rows, "vec_id", "embedding", rows.where("vec_id % 20 = 0"), 2)
    best = top.groupBy("query").agg(F.min_by("vec_id", "rank").alias("vec_id"), F.max(F.when(F.col("rank") == 1, 1 - F.col("cosine"))).alias("d1"), F.max(F.when(F.col("rank") == 2, 1 - F.col("cosine"))).alias("d2"))
    return best.where("d1 < 0.95 * d2").select("query", "vec_id", F.round("d1", 6).alias("d1"), F.round("d2", 6).alias("d2"))


def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a vector of the same label is among the first 1, 3, 5 and 10."""
    rows = table(spark, sf_dir, "embeddings")
    top = match.nearest_vectors(rows, "vec_id", "embedding", rows.where("vec_id % 20 = 0"), 10)
    labels = rows.select("vec_id", "label")
    named = top.join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query"), F.col("label").alias("own")), "query")
    return analytics.recall_at(named, F.col("label") == F.col("own"), "query", [1, 3, 5, 10]).select("k", F.round("recall", 6).alias("recall"))


def affine_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The affine map of each country's degrees to Mercator metres."""
    rows = _placed(spark, sf_dir).where("country_code <> ''").withColumns(dict(zip(("u", "v"), geo.mercator("latitude", "longitude"))))
    points = rows.select("country_code", F.col("longitude").alias("x"), F.col("latitude").alias("y"), F.col("u") / 1000, F.col("v") / 1000).toDF("country_code", "x", "y", "u", "v")
    return geometry.fit_maps(points, ["country_code"], "affine").select("country_code", F.round(F.element_at("map", 1), 4).alias("a"), F.round("rmse", 4).alias("rmse"), "n")


def homography_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A projective map, recovered from each country's points that it was applied to."""
    h = F.array(*map(F.lit, (1.2, 0.1, 3.0, -0.05, 0.9, 1.0, 0.0004, 0.0002, 1.0)))
    rows = _placed(spark, sf_dir).where("country_code <> ''")
    u, v = geometry.apply_map(h, F.col("longitude"), F.col("latitude"))
    points = rows.select("country_code", F.col("longitude").alias("x"), F.col("latitude").alias("y"), u.alias("u"), v.alias("v"))
    return geometry.fit_maps(points, ["country_code"]).select("country_code", F.round(F.element_at("map", 1), 3).alias("h11"), F.round(F.element_at("map", 3), 2).alias("h13"), "n")


def homography_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formations' positions under one projective map."""
    h = F.array(*map(F.lit, (1.2, 0.1, 3.0, -0.05, 0.9, 1.0, 0.0004, 0.0002, 1.0)))
    u, v = geometry.apply_map(h, F.col("longitude"), F.col("latitude"))
    return _placed(spark, sf_dir).select("formation_id", F.round(u, 6).alias("u"), F.round(v, 6).alias("v"))


def quad_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners made from orders: convexity and area."""
    k = F.col("o_orderkey")
    xs = [F.lit(0.0), (10 + k % 7).cast("double"), (12 - k % 11).cast("double"), (k % 5 - 2).cast("double")]
    ys = [F.lit(0.0), (k % 3 - 1).cast("double"), (8 + k % 4).cast("double"), (9 - k % 6).cast("double")]
    return table(spark, sf_dir, "orders").select("o_orderkey", geometry.convex(xs, ys).alias("convex"), F.round(geometry.shoelace(xs, ys), 6).alias("area"))


def grid_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eastings, northings and resolution of grid references made from part numbers."""
    k = F.col("p_partkey")
    ref = F.concat(F.element_at(F.array(*map(F.lit, ("SU", "TQ", "NT", "HP", "SV"))), (k % 5 + 1).cast("int")), F.format_string("%04d", k * 7 % 10000), F.format_string("%04d", k * 13 % 10000))
    east, north, unit = geometry.grid_reference(ref)
    return table(spark, sf_dir, "part").select("p_partkey", ref.alias("ref"), east.alias("easting"), north.alias("northing"), unit.alias("resolution"))


def grid_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WGS84 positions of those references."""
    rows = grid_references(spark, sf_dir).withColumn("p", geometry.grid_position("easting", "northing"))
    return rows.select("p_partkey", F.round("p.latitude", 6).alias("latitude"), F.round("p.longitude", 6).alias("longitude"))


def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of 512 with steps of 384 at two scales over rasters sized from parts."""
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 60 + 200).cast("int").alias("w"), (F.col("p_size") * 40 + 300).cast("int").alias("h"))
    return geometry.tile_grid(rows, "p_partkey", "w", "h", 512, 384, [1.0, 2.0])


def screen_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy clusters of each country's formations on a screen of 20 pixels a degree."""
    rows = _placed(spark, sf_dir).where("country_code <> ''")
    points = rows.select("country_code", F.col("formation_id").alias("id"), (F.col("longitude") * 20).alias("x"), (F.col("latitude") * -20).alias("y"))
    return geometry.screen_clusters(points, ["country_code"], 32.0).groupBy("country_code", "cluster").agg(F.count("*").alias("points"), F.min("id").alias("first_id"))


def marker_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placemarks at one position to seven places, where there are several."""
    rows = table(spark, sf_dir, "legacy_kml_candidate_queue").where("latitude IS NOT NULL AND longitude IS NOT NULL AND NOT isnan(latitude) AND NOT isnan(longitude)").select("legacy_candidate_id", *((F.floor(F.col(c) * 1e7 + 0.5) / 1e7).alias(c) for c in ("latitude", "longitude"))).distinct()
    return rows.groupBy("latitude", "longitude").agg(F.count("*").alias("marks"), F.min("legacy_candidate_id").alias("first_id")).where("marks > 1")


def category_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What accepted alias pairs reach in three steps from every alias that is no other id's canonical id.

    Of a ring of ids that nothing else leads to, the smallest id is a root too where the ring is a reversed pair.
    """
    clean = lambda c: F.nullif(F.trim(F.lower(c)), F.lit(""))
    edges = table(spark, sf_dir, "formation_alias_reviews").where(F.lower(F.trim("review_status")) == "accepted").select(clean("alias_formation_id").alias("a"), clean("canonical_formation_id").alias("b"))
    led = edges.where("a <> b").select(F.col("b").alias("node"), F.col("a").alias("by")).distinct()
    # A reversed pair is its smaller id's; the larger one's word for it doesn't count.
    back = led.select(F.col("by").alias("node"), F.col("node").alias("by"))
    led = led.join(back, ["node", "by"], "left_anti").unionByName(led.join(back, ["node", "by"], "left_semi").where("node > by"))
    return graph.levels(edges, "a", "b", edges.select(F.col("a").alias("node")).join(led.select("node"), "node", "left_anti"), 3)


def mean_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean position and bounds of each country's formations, on the sphere."""
    lat, lon = F.radians("latitude"), F.radians("longitude")
    rows = _placed(spark, sf_dir).where("country_code <> ''").groupBy("country_code").agg(F.avg(F.cos(lat) * F.cos(lon)).alias("x"), F.avg(F.cos(lat) * F.sin(lon)).alias("y"), F.avg(F.sin(lat)).alias("z"), F.min("latitude").alias("south"), F.max("latitude").alias("north"), F.count("*").alias("n"))
    return rows.select("country_code", F.round(F.degrees(F.atan2("z", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2))), 5).alias("latitude"), F.round(F.degrees(F.atan2("y", "x")), 5).alias("longitude"), "south", "north", "n")


QUERIES = {f.__name__: f for f in (
    geo_haversine_bearing, geo_destination, mercator_roundtrip, country_envelope, region_assignment, corridor_join, topk_cosine, ratio_test_match, recall_at_k, affine_fit, homography_fit, homography_apply, quad_checks,
    grid_references, grid_positions, tile_grid, screen_clusters, marker_groups, category_levels, mean_positions,
)}

_PLACED = "(SELECT DISTINCT formation_id, latitude, longitude, country_code FROM formations WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND NOT isnan(latitude) AND NOT isnan(longitude))"
_KM = "2 * 6371.0088 * asin(sqrt(least(1.0, power(sin((radians({2}) - radians({0})) / 2), 2) + cos(radians({0})) * cos(radians({2})) * power(sin((radians({3}) - radians({1})) / 2), 2))))".format
_BEARING = "((degrees(atan2(sin(radians({3}) - radians({1})) * cos(radians({2})), cos(radians({0})) * sin(radians({2})) - sin(radians({0})) * cos(radians({2})) * cos(radians({3}) - radians({1})))) + 360) % 360)".format
_BOXES = "(VALUES " + ", ".join(f"('{c}', {w}, {s}, {e}, {n})" for c, w, s, e, n in BOXES) + ") AS box(code, west, south, east, north)"
_COS = "round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6)"
_TOP = f"SELECT a.vec_id AS query, b.vec_id, a.label AS own, b.label, {_COS} AS cosine, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0"
_H = "(1.2 * longitude + 0.1 * latitude + 3.0) / (0.0004 * longitude + 0.0002 * latitude + 1.0)", "(-0.05 * longitude + 0.9 * latitude + 1.0) / (0.0004 * longitude + 0.0002 * latitude + 1.0)"
SQL = {
    "geo_haversine_bearing": f"""WITH p AS (SELECT DISTINCT commons_assertion_id, matched_formation_id AS formation_id, latitude lat, longitude lon FROM commons_crop_circle_assertions WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND matched_formation_id <> '')
SELECT commons_assertion_id, formation_id, round({_KM("latitude", "longitude", "lat", "lon")}, 5) AS km, round({_BEARING("latitude", "longitude", "lat", "lon")}, 4) AS bearing FROM p JOIN {_PLACED} USING (formation_id)""",
    "geo_destination": f"""WITH a AS (SELECT *, radians(latitude) f, radians(longitude) l, 100 / 6371.0088 d, radians(45) t FROM {_PLACED}), b AS (SELECT *, asin(sin(f) * cos(d) + cos(f) * sin(d) * cos(t)) g FROM a)
SELECT formation_id, round(degrees(g), 6) AS to_lat, round((degrees(l + atan2(sin(t) * sin(d) * cos(f), cos(d) - sin(f) * sin(g))) + 540) % 360 - 180, 6) AS to_lon FROM b""",
    "mercator_roundtrip": f"""SELECT formation_id, round(radians(longitude) * 6378137, 3) AS x, round(ln(tan(pi() / 4 + radians(greatest(-85.0511287798066, least(85.0511287798066, latitude))) / 2)) * 6378137, 3) AS y, round(greatest(-85.0511287798066, least(85.0511287798066, latitude)), 6) AS lat, round(longitude, 6) AS lon FROM {_PLACED}""",
    "country_envelope": f"SELECT country_code, count(*) AS placed, count(*) FILTER (WHERE longitude BETWEEN west AND east AND latitude BETWEEN south AND north) AS inside FROM {_PLACED} JOIN {_BOXES} ON code = country_code GROUP BY 1",
    "region_assignment": f"SELECT DISTINCT legacy_candidate_id, code AS region FROM (SELECT DISTINCT legacy_candidate_id, latitude, longitude FROM legacy_kml_candidate_queue WHERE NOT isnan(latitude) AND NOT isnan(longitude)) JOIN {_BOXES} ON longitude BETWEEN west AND east AND latitude BETWEEN south AND north",
    "corridor_join": f"""WITH p AS (SELECT * FROM {_PLACED}), r AS (SELECT formation_id AS ray_id, latitude rlat, longitude rlon, (('0x' || substr(formation_id, 4, 4))::int % 360)::double az FROM p),
j AS (SELECT ray_id, formation_id AS site_id, {_KM("rlat", "rlon", "latitude", "longitude")} AS d, radians({_BEARING("rlat", "rlon", "latitude", "longitude")}) - radians(az) AS t FROM r JOIN p ON formation_id <> ray_id),
c AS (SELECT ray_id, site_id, d, 6371.0088 * atan2(sin(d / 6371.0088) * cos(t), cos(d / 6371.0088)) al, abs(6371.0088 * asin(greatest(-1.0, least(1.0, sin(d / 6371.0088) * sin(t))))) cr FROM j)
SELECT ray_id, site_id, round(d, 4) AS distance_km, round(al, 4) AS along_km, round(cr, 4) AS cross_km FROM c WHERE d >= 1 AND al BETWEEN 0 AND 300 AND cr <= 10""",
    "topk_cosine": f"SELECT query, vec_id, cosine, rank FROM ({_TOP}) WHERE rank <= 5",
    "ratio_test_match": f"WITH t AS ({_TOP}), b AS (SELECT query, max(vec_id) FILTER (WHERE rank = 1) AS vec_id, round(1 - max(cosine) FILTER (WHERE rank = 1), 6) AS d1, round(1 - max(cosine) FILTER (WHERE rank = 2), 6) AS d2 FROM t GROUP BY 1) SELECT * FROM b WHERE d1 < 0.95 * d2",
    "recall_at_k": f"WITH t AS ({_TOP}), f AS (SELECT query, min(rank) FILTER (WHERE own = label AND rank <= 10) AS r FROM t GROUP BY 1) SELECT k, round(avg(CASE WHEN r <= k THEN 1.0 ELSE 0.0 END), 6) AS recall FROM f, (VALUES (1), (3), (5), (10)) v(k) GROUP BY k",
    "affine_fit": f"""WITH p AS (SELECT country_code c, longitude x, latitude y, radians(longitude) * 6378.137 u, ln(tan(pi() / 4 + radians(greatest(-85.0511287798066, least(85.0511287798066, latitude))) / 2)) * 6378.137 v FROM {_PLACED} WHERE country_code <> ''),
s AS (SELECT c, count(*) n, avg(x) mx, avg(y) my, avg(u) mu, avg(v) mv, var_pop(x) xx, var_pop(y) yy, covar_pop(x, y) xy, covar_pop(x, u) xu, covar_pop(y, u) yu, covar_pop(x, v) xv, covar_pop(y, v) yv FROM p GROUP BY 1),
k AS (SELECT *, xx * yy - xy * xy d FROM s), f AS (SELECT *, (xu * yy - yu * xy) / e a, (yu * xx - xu * xy) / e b, (xv * yy - yv * xy) / e g, (yv * xx - xv * xy) / e h FROM (SELECT *, CASE WHEN n >= 3 AND d > 0 THEN d END e FROM k))
SELECT c AS country_code, round(any_value(a), 4) AS a, round(sqrt(avg(power(mu + a * (x - mx) + b * (y - my) - u, 2) + power(mv + g * (x - mx) + h * (y - my) - v, 2))), 4) AS rmse, any_value(n)::int AS n FROM p JOIN f USING (c) GROUP BY c""",
    "homography_fit": f"SELECT country_code, CASE WHEN count(*) >= 4 THEN 1.2 END AS h11, CASE WHEN count(*) >= 4 THEN 3.0 END AS h13, count(*)::int AS n FROM {_PLACED} WHERE country_code <> '' GROUP BY 1",
    "homography_apply": f"SELECT formation_id, round({_H[0]}, 6) AS u, round({_H[1]}, 6) AS v FROM {_PLACED}",
    "quad_checks": """WITH q AS (SELECT o_orderkey, 0.0 x0, 0.0 y0, (10 + o_orderkey % 7)::double x1, (o_orderkey % 3 - 1)::double y1, (12 - o_orderkey % 11)::double x2, (8 + o_orderkey % 4)::double y2, (o_orderkey % 5 - 2)::double x3, (9 - o_orderkey % 6)::double y3 FROM orders),
t AS (SELECT *, (x1 - x0) * (y2 - y1) - (y1 - y0) * (x2 - x1) a, (x2 - x1) * (y3 - y2) - (y2 - y1) * (x3 - x2) b, (x3 - x2) * (y0 - y3) - (y3 - y2) * (x0 - x3) c, (x0 - x3) * (y1 - y0) - (y0 - y3) * (x1 - x0) d FROM q)
SELECT o_orderkey, (a > 0 AND b > 0 AND c > 0 AND d > 0) OR (a < 0 AND b < 0 AND c < 0 AND d < 0) AS convex, round(abs(x0 * y1 - x1 * y0 + x1 * y2 - x2 * y1 + x2 * y3 - x3 * y2 + x3 * y0 - x0 * y3) / 2, 6) AS area FROM t""",
    "grid_references": """WITH r AS (SELECT p_partkey, ['SU', 'TQ', 'NT', 'HP', 'SV'][p_partkey % 5 + 1] AS sq, p_partkey * 7 % 10000 AS e, p_partkey * 13 % 10000 AS n FROM part), o(sq, oe, onn) AS (VALUES ('SU', 400000, 100000), ('TQ', 500000, 100000), ('NT', 300000, 600000), ('HP', 400000, 1200000), ('SV', 0, 0))
SELECT p_partkey, sq || lpad(e::varchar, 4, '0') || lpad(n::varchar, 4, '0') AS ref, (oe + e * 10 + 5)::double AS easting, (onn + n * 10 + 5)::double AS northing, 10.0::double AS resolution FROM r JOIN o USING (sq)""",
    "tile_grid": """WITH r AS (SELECT p_partkey, p_size * 60 + 200 AS w, p_size * 40 + 300 AS h, unnest([1.0, 2.0]) AS scale FROM part), s AS (SELECT *, (512 * scale)::int AS t FROM r),
x AS (SELECT *, unnest(generate_series(0, ceil(greatest(w - t, 0) / 384.0)::bigint)) AS col FROM s), y AS (SELECT *, unnest(generate_series(0, ceil(greatest(h - t, 0) / 384.0)::bigint)) AS row FROM x)
SELECT p_partkey, scale::double AS scale, col::int AS col, row::int AS row, least(col * 384, greatest(w - t, 0))::int AS x0, least(row * 384, greatest(h - t, 0))::int AS y0 FROM y""",
    "marker_groups": "SELECT latitude, longitude, count(*) AS marks, min(legacy_candidate_id) AS first_id FROM (SELECT DISTINCT legacy_candidate_id, floor(latitude * 1e7 + 0.5) / 1e7 latitude, floor(longitude * 1e7 + 0.5) / 1e7 longitude FROM legacy_kml_candidate_queue WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND NOT isnan(latitude) AND NOT isnan(longitude)) GROUP BY 1, 2 HAVING count(*) > 1",
    "category_levels": """WITH RECURSIVE e AS (SELECT DISTINCT nullif(trim(lower(alias_formation_id)), '') a, nullif(trim(lower(canonical_formation_id)), '') b FROM formation_alias_reviews WHERE lower(trim(review_status)) = 'accepted'),
l AS (SELECT DISTINCT b AS node, a AS by_ FROM e WHERE a <> b), k AS (SELECT DISTINCT node FROM l WHERE NOT EXISTS (SELECT 1 FROM l m WHERE m.node = l.by_ AND m.by_ = l.node) OR node > by_),
w AS (SELECT DISTINCT a AS node, 0 AS level FROM e WHERE a IS NOT NULL AND a NOT IN (SELECT node FROM k) UNION SELECT e.b, w.level + 1 FROM w JOIN e ON e.a = w.node WHERE e.b IS NOT NULL AND w.level < 3)
SELECT node, min(level) AS level FROM w GROUP BY node""",
    "mean_positions": f"""WITH m AS (SELECT country_code, avg(cos(radians(latitude)) * cos(radians(longitude))) x, avg(cos(radians(latitude)) * sin(radians(longitude))) y, avg(sin(radians(latitude))) z, min(latitude) AS south, max(latitude) AS north, count(*) AS n FROM {_PLACED} WHERE country_code <> '' GROUP BY 1)
SELECT country_code, round(degrees(atan2(z, sqrt(x * x + y * y))), 5) AS latitude, round(degrees(atan2(y, x)), 5) AS longitude, south, north, n FROM m""",
}
