import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian.functions import dates, geo, text
from meridian.operators import analytics, audit, geometry, graph, match, resolve
from meridian.plans import space_queries

ONE = "SELECT 1 AS one"


def value(spark, column):
    return spark.sql(ONE).select(column.alias("v")).first()[0]


def test_destination_distance_and_tracks(spark):
    lat, lon = geo.destination(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1000.0))
    assert value(spark, lat) == pytest.approx(8.9932, abs=1e-3) and value(spark, lon) == pytest.approx(0)
    lat, lon = geo.destination(F.lit(40.0), F.lit(-100.0), F.lit(90.0), F.lit(250.0))
    along, cross = geo.track(F.lit(40.0), F.lit(-100.0), F.lit(90.0), lat, lon)
    assert value(spark, along) == pytest.approx(250) and abs(value(spark, cross)) < 1e-6
    assert value(spark, geo.haversine_km(F.lit(None).cast("double"), F.lit(0.0), F.lit(1.0), F.lit(1.0))) is None
    assert value(spark, geo.axis_difference(F.lit(178.0), F.lit(2.0), 180.0)) == pytest.approx(4)


@pytest.mark.parametrize("a,b,want", [("2003-07-04", "2003-08-08", "later"), ("1994-06-14", "1994-06-08", "earlier"), ("2003-07", "2003-07-24", "overlap_or_indeterminate"), ("2003", "2003-08-08", "overlap_or_indeterminate"), ("x", "2003", "overlap_or_indeterminate"), ("2003-13", "2003", "overlap_or_indeterminate")])
def test_relations_of_partial_dates(spark, a, b, want):
    assert value(spark, dates.relation(F.lit(a), F.lit(b))) == want


@pytest.mark.parametrize("label,want", [("early July 2003", "2003-07"), ("12 July 2003, near the road", "2003-07-12"), ("in 1999", "1999"), ("Sept 4 ", None), ("", None)])
def test_labels(spark, label, want):
    assert value(spark, dates.labelled(F.lit(label))) == want


def test_texts(spark):
    assert value(spark, text.folded(F.lit("Île-aux-Blés (2)"))) == "ile aux bles 2"
    assert value(spark, text.canonical_url(F.lit("HTTPS://WWW.Example.ORG/A?b=1#c"))) == "https://www.example.org/A?b=1"
    assert value(spark, text.canonical_url(F.lit("ftp://x/"))) is None
    assert value(spark, text.links(F.lit("see https://a.example/x. and https://a.example/x, (http://b.example/y)"))) == ["https://a.example/x", "http://b.example/y"]
    assert value(spark, text.place_similarity(F.lit("Alton Barnes"), F.lit("barnes, ALTON"))) == 1.0
    assert value(spark, text.inert_text(F.lit("<p>a &amp; b</p><script>x</script><br>c"))) == "a & b\nc"
    assert value(spark, text.listed(F.lit(" a; ;b;"))) == ["a", "b"]


@pytest.mark.parametrize("ref,lat,lon", [("SU1251075303", 51.476556, -1.821250)])
def test_grid_reference(spark, ref, lat, lon):
    east, north, unit = geometry.grid_reference(F.lit(ref))
    row = spark.sql(ONE).select(east.alias("e"), north.alias("n"), unit.alias("u")).withColumn("p", geometry.grid_position("e", "n")).first()
    assert row.u == 1.0 and row.p.latitude == pytest.approx(lat, abs=2e-5) and row.p.longitude == pytest.approx(lon, abs=2e-5)
    assert value(spark, geometry.grid_reference(F.lit("TV2010.jpg"))[0]) is None


def test_homography_is_recovered_and_degenerate_points_refused():
    rng = np.random.default_rng(3)
    h = np.array([[1.2, 0.1, 3], [-0.05, 0.9, 1], [0.001, 0.002, 1]])
    x, y = rng.uniform(0, 100, (2, 9))
    p = h @ np.stack([x, y, np.ones(9)])
    assert np.allclose(geometry.fit_homography(x, y, p[0] / p[2], p[1] / p[2]), h, atol=1e-6)
    assert geometry.fit_homography(x, 2 * x, p[0], p[1]) is None


def test_screen_clusters(spark):
    points = spark.createDataFrame([("near", "a", 100.0, 100.0), ("near", "b", 145.0, 126.0), ("far", "a", 100.0, 100.0), ("far", "b", 400.0, 400.0)], "view string, id string, x double, y double")
    got = geometry.screen_clusters(points, ["view"], 64.0).groupBy("view").agg(F.count_distinct("cluster").alias("n"))
    assert {r.view: r.n for r in got.collect()} == {"near": 1, "far": 2}


def test_keyed_resolution(spark):
    rows = spark.createDataFrame([("k", 1, "", 5), ("k", 2, "x", 7), ("k", 3, "y", 7), ("j", 1, None, 1)], "key string, ord int, v string, score int")
    first = {r.key: r.v for r in rows.groupBy("key").agg(resolve.first_present("v", F.col("ord")).alias("v")).collect()}
    assert first == {"k": "x", "j": None}
    assert [r.key for r in resolve.strict_best(rows, ["key"], "score", "ord").collect()] == ["j"]
    assert resolve.keep_first(rows, ["key"], F.col("ord")).count() == 2
    newer = spark.createDataFrame([("k", "z")], "key string, v string")
    assert {(r.key, r.v) for r in resolve.last_wins([rows.where("ord = 1").select("key", "v"), newer], ["key"]).collect()} == {("k", "z"), ("j", None)}


def test_cascade_needs_one_entity(spark):
    known = spark.createDataFrame([("e1", "a", "p"), ("e2", "b", "q"), ("e3", "b", "r")], "entity string, x string, y string")
    rows = spark.createDataFrame([(1, "a", "p"), (2, "b", "zz"), (3, "zz", "r"), (4, None, None)], "id int, x string, y string")
    tiers = [("x", [F.col("x")], [F.col("x")]), ("y", [F.col("y")], [F.col("y")])]
    got = {r.id: (r.entity, r.tier) for r in match.cascade(rows, known, "id", "entity", tiers).collect()}
    assert got == {1: ("e1", "x"), 2: (None, "new"), 3: ("e3", "y"), 4: (None, "new")}


def test_interval_join_with_open_ends(spark):
    d = lambda v: v and dt.date.fromisoformat(v)
    spans = [("a", d("2020-01-01"), d("2020-03-01")), ("b", d("2020-02-01"), d("2020-02-02")), ("c", d("2021-01-01"), None), ("e", None, d("2020-01-01")), ("f", None, None), ("g", d("2020-05-01"), d("2022-01-01"))]
    left = spark.createDataFrame([(1, *s) for s in spans], "k int, a string, lo date, hi date")
    right = spark.createDataFrame([(1, *s) for s in spans], "k int, b string, lo2 date, hi2 date")
    got = sorted((r.a, r.b) for r in match.interval_join(left, right, ["k"], "lo", "hi", "lo2", "hi2").collect())
    low, high = lambda v: v or dt.date.min, lambda v: v or dt.date.max
    assert got == sorted((s[0], t[0]) for s in spans for t in spans if low(s[1]) <= high(t[2]) and low(t[1]) <= high(s[2]))


def test_nearest_vectors_against_brute_force(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(200, 8)).round(2)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(900, []), (901, None), (902, [0.0] * 8), (903, [float(x) for x in m[3]])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = match.nearest_vectors(df, "id", "v", df.where("id % 20 = 0"), 4).collect()
    full = {i: np.array(v, np.float32).astype(float) for i, v in rows if v and any(v)}
    for q in range(0, 200, 20):
        cos = sorted((-round(float(full[q] @ v / np.linalg.norm(full[q]) / np.linalg.norm(v)), 6), i) for i, v in full.items() if i != q)[:4]
        assert [(r.id) for r in sorted((r for r in got if r.query == q), key=lambda r: r.rank)] == [i for _, i in cos]
    assert match.nearest_vectors(df.limit(0), "id", "v", df.limit(0), 4).count() == 0


def test_corridor_wraps_and_excludes(spark):
    rays = spark.createDataFrame([("r", 0.0, 179.5, 90.0, 200.0, 10.0)], "ray string, ray_lat double, ray_lon double, azimuth double, range_km double, corridor_km double")
    sites = spark.createDataFrame([("r", 0.0, 179.9), ("over", 0.01, -179.5), ("behind", 0.0, 178.9), ("aside", 0.3, -179.5), ("far", 0.0, -177.0), ("at", 0.0, 179.5)], "site string, site_lat double, site_lon double")
    assert [r.site for r in match.corridor_join(rays, sites, "ray", "site").collect()] == ["over"]


def test_aggregates(spark):
    rows = spark.createDataFrame([("g", 170.0, 1.0), ("g", 10.0, 1.0), ("h", 90.0, 0.0)], "g string, a double, w double")
    got = {r.g: r for r in analytics.axial_mean(rows, ["g"], "a", "w").collect()}
    assert min(got["g"].axis_mean, 180 - got["g"].axis_mean) == pytest.approx(0, abs=1e-9) and got["g"].axis_deviation == pytest.approx(10) and got["h"].axis_deviation == 90
    said = spark.createDataFrame([(True, True)] * 24 + [(False, True)] * 3 + [(False, False)] * 64 + [(True, False)] * 13, "t boolean, s boolean")
    r = analytics.confusion(said, F.col("t"), F.col("s")).first()
    assert (r.precision, r.recall, r.f1) == (0.8889, 0.6486, 0.75)
    axes = spark.createDataFrame([("g", 10.0, 5.0), ("g", 13.0, 1.0), ("g", 100.0, 2.0), ("g", None, 9.0)], "g string, a double, w double")
    assert [(round(r.axis, 1), r.support, r.members, r.longest) for r in analytics.segment_clusters(axes, ["g"], "a", "w").orderBy("cluster").collect()] == [(10.5, 6.0, 2, 5.0), (100.0, 2.0, 1, 2.0)]


def test_levels_and_audits(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), (None, "x")], "s string, t string")
    roots = spark.createDataFrame([("a",)], "node string")
    assert {r.node: r.level for r in graph.levels(edges, "s", "t", roots, 3).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert sorted(r.t for r in audit.orphans(edges, "t", edges, "s").collect()) == ["e", "x"]
    with pytest.raises(ValueError):
        audit.certified(edges, "s", 99, ["s"])


def test_tiles_reach_the_edges(spark):
    rasters = spark.createDataFrame([("r", 1000, 600), ("small", 100, 100), ("none", 0, 5), ("null", None, 5)], "k string, w int, h int")
    tiles = geometry.tile_grid(rasters, "k", "w", "h", 512, 512, [1.0]).collect()
    assert {(t.k, t.x0, t.y0) for t in tiles} == {("r", 0, 0), ("r", 488, 0), ("r", 0, 88), ("r", 488, 88), ("small", 0, 0)}
    assert math.isclose(1.0, tiles[0].scale)


def test_corridor_of_every_formation(spark, tmp_path):
    rng = np.random.default_rng(11)
    rows = [(f"cc_{i * 4099 % 65536:04x}{i:08x}", float(50 + a), float(b), "GB") for i, (a, b) in enumerate(rng.uniform(0, 3, (80, 2)))] + [("cc_f0000000aaaa", -17.0, 179.9, "FJ"), ("cc_005a0000aaaa", -17.0, -179.5, "FJ"), ("cc_e05a0000bbbb", 89.0, 0.0, ""), ("cc_e05a0000cccc", 89.5, 170.0, "")]
    df = spark.createDataFrame(rows, "formation_id string, latitude double, longitude double, country_code string")
    df.write.parquet(f"{tmp_path}/formations.parquet")
    got = {(r.ray_id, r.site_id) for r in space_queries.corridor_join(spark, str(tmp_path)).collect()}
    rays = df.selectExpr("formation_id AS r", "latitude AS a", "longitude AS b", "CAST(CAST(conv(substring(formation_id, 4, 4), 16, 10) AS int) % 360 AS double) AS z")
    along, cross = geo.track("a", "b", "z", "latitude", "longitude")
    pairs = rays.crossJoin(df).where("r <> formation_id").withColumns({"d": geo.haversine_km("a", "b", "latitude", "longitude"), "al": along, "cr": F.abs(cross)}).where("d >= 1 AND al BETWEEN 0 AND 300 AND cr <= 10")
    want = {(p.r, p.formation_id) for p in pairs.collect()}
    assert got == want and len({r for r, _ in got if r[3] not in "01"}) > 20


@pytest.mark.parametrize("kind", ["homography", "affine"])
def test_maps_of_large_groups_against_single_fits(spark, kind):
    rng = np.random.default_rng(4)
    x, y = rng.uniform(-5, 5, (2, 6000)) + np.array([[-100], [40]])
    w = 0.0004 * x + 0.0002 * y + 1 if kind == "homography" else 1.0
    u, v = (1.2 * x + 0.1 * y + 3 + rng.normal(0, 1e-4, 6000)) / w, (-0.05 * x + 0.9 * y + 1 + rng.normal(0, 1e-4, 6000)) / w
    rows = [("all", *map(float, r)) for r in zip(x, y, u, v)] + [("line", float(i), 2.0 * i, float(i), 0.0) for i in range(9)] + [("few", 0.0, 1.0, 2.0, 3.0), (None, None, 1.0, 1.0, 1.0)]
    got = {r.g: r for r in geometry.fit_maps(spark.createDataFrame(rows, "g string, x double, y double, u double, v double"), ["g"], kind).collect()}
    h = np.array(got["all"].map).reshape(3, 3)
    if kind == "homography":
        part = slice(0, 1500)  # the single fit keeps a square of its rows
        want = geometry.fit_homography(x[part], y[part], u[part], v[part])
    else:
        want = np.vstack([np.linalg.lstsq(np.stack([x, y, np.ones(6000)], 1), np.stack([u, v], 1), rcond=None)[0].T, [0, 0, 1]])
    p = h @ np.stack([x, y, np.ones(6000)])
    assert np.allclose(h, want, rtol=1e-3, atol=1e-3) and got["all"].n == 6000
    assert got["all"].rmse == pytest.approx(np.sqrt(((p[:2] / p[2] - [u, v]) ** 2).sum(0).mean())) and got["all"].rmse < 1e-3
    assert (got["line"].map, got["few"].map, got["few"].rmse, got["line"].n) == (None, None, None, 9) and None not in got


def test_fits_take_all_ids(spark, tmp_path):
    places = [(f"cc_{i:02x}", 50.0 + i % 7, -3.0 + i % 5 * (1 + i % 2), "GB") for i in range(0, 256, 4)]
    spark.createDataFrame(places, "formation_id string, latitude double, longitude double, country_code string").write.parquet(f"{tmp_path}/formations.parquet")
    assert [f(spark, str(tmp_path)).first().n for f in (space_queries.affine_fit, space_queries.homography_fit)] == [64, 64]


def test_levels_from_all_roots(spark, tmp_path):
    pairs = [("cc_f1", "cc_f2"), ("cc_f2", "cc_f3"), ("cc_f3", "cc_f4"), ("cc_f4", "cc_f5"), ("cc_a1", "cc_a1"), ("cc_a1", "cc_a2"), ("cc_b1", "cc_b2"), ("cc_b2", "cc_b1")]
    spark.createDataFrame([(a, b, "accepted") for a, b in pairs], "alias_formation_id string, canonical_formation_id string, review_status string").write.parquet(f"{tmp_path}/formation_alias_reviews.parquet")
    got = {r.node: r.level for r in space_queries.category_levels(spark, str(tmp_path)).collect()}
    assert got == {"cc_f1": 0, "cc_f2": 1, "cc_f3": 2, "cc_f4": 3, "cc_a1": 0, "cc_a2": 1, "cc_b1": 0, "cc_b2": 1}
