"""Inputs beyond what was once allowed, and plans that hold nothing whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from meridian.functions.geo import destination, haversine_km, track
from meridian.operators import geometry, match, views


def test_screen_clusters_of_any_number_of_points(spark):
    # A view of more points than were once allowed, and views whose clusters a plain loop finds too.
    many = spark.range(100_001).select(F.lit("many").alias("view"), F.col("id").cast("string").alias("id"), (F.col("id") % 1000).cast("double").alias("x"), F.lit(0.0).alias("y"))
    rng = np.random.default_rng(17)
    some = [(v, f"{i:04d}", float(x), float(y)) for v in ("a", None) for i, (x, y) in enumerate(rng.uniform(0, 300, (1500, 2)).round(1))]
    points = many.unionByName(spark.createDataFrame([*some, *some[:5]], "view string, id string, x double, y double"))
    got = {(r.view, r.id): r.cluster for r in geometry.screen_clusters(points, ["view"], 20.0).collect()}
    assert len(got) == 100_001 + len(some)
    for view in ("a", None):
        centres = []
        for _, i, x, y in sorted((r for r in some if r[0] == view), key=lambda r: (r[2], r[3], r[1])):
            near = min(((float(np.hypot(c[0] - x, c[1] - y)), k) for k, c in enumerate(centres)), default=(float("inf"), 0))
            if near[0] > 20:
                near = (0, len(centres))
                centres.append([0.0, 0.0, 0])
            c = centres[near[1]]
            c[2] += 1
            c[0] += (x - c[0]) / c[2]
            c[1] += (y - c[1]) / c[2]
            assert got[view, i] == near[1] + 1
        assert len(centres) > 50


def test_view_clusters_of_any_number_of_points(spark):
    n = F.col("id")
    points = spark.range(100_001).select(n.cast("string").alias("id"), (n % 1440).cast("double").alias("x"), (n % 900).cast("double").alias("y"), F.lit(51.0).alias("lat"), F.lit(0.0).alias("lon"), F.lit(1).alias("images"), F.lit("r").alias("role"), F.lit(False).alias("selected"))
    sums = views.view_clusters(points, 6, 1440, 900).agg(F.sum("reports"), F.sum("images"), F.count("*")).first()
    assert sums[:2] == (100_001, 100_001) and sums[2] > 20


@pytest.mark.parametrize("query", ["lookup_tiers", "partial_references", "alignments", "corridor_join"])
def test_sides_that_grow_are_not_broadcast(spark, data, query):
    df = queries()[query](spark, data)
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    df.collect()
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_products_tell_corridors_as_the_formulas_do(spark):
    # What products leave open is told by the formulas: ranges beyond half the way around, corridors beyond a quarter, poles, edges.
    rng = np.random.default_rng(23)
    lat, lon, turn = rng.uniform(-90, 90, 60), rng.uniform(-180, 180, 60), rng.uniform(0, 360, 60)
    reach, wide = np.resize([30.0, 4000.0, 25000.0], 60), np.resize([0.5, 50.0, 800.0, 11000.0], 60)
    rays = spark.createDataFrame([(f"r{i}", *map(float, r)) for i, r in enumerate(zip(np.append(lat[:58], [90, -90]), lon, turn, reach, wide))], "ray string, ray_lat double, ray_lon double, azimuth double, range_km double, corridor_km double")
    at = [(f"s{i}", *map(float, p)) for i, p in enumerate(zip(rng.uniform(-90, 90, 300), rng.uniform(-180, 180, 300)))]
    ends = destination("ray_lat", "ray_lon", "azimuth", F.col("range_km"))
    near = rays.select(F.concat(F.lit("e"), "ray").alias("site"), *(c.alias(n) for c, n in zip(ends, ("site_lat", "site_lon"))))
    sites = spark.createDataFrame([*at, ("p", 90.0, 0.0), ("none", None, None)], "site string, site_lat double, site_lon double").unionByName(near)
    along, cross = track("ray_lat", "ray_lon", "azimuth", "site_lat", "site_lon")
    maybe, surely, columns = match._corridor_test(match._unit_vector(F.col("site_lat"), F.col("site_lon")))
    inside = (haversine_km("ray_lat", "ray_lon", "site_lat", "site_lon") >= 1) & (along >= 0) & (along <= F.col("range_km")) & (F.abs(cross) <= F.col("corridor_km"))
    told = rays.withColumns(columns).crossJoin(sites).select(F.coalesce(maybe, F.lit(False)).alias("m"), F.coalesce(surely, F.lit(False)).alias("s"), F.coalesce(inside, F.lit(False)).alias("i")).groupBy("m", "s", "i").count().collect()
    ways = {(r.m, r.s, r.i): r["count"] for r in told}
    assert not any(i and not m or s and not i for m, s, i in ways), ways
    assert ways[True, True, True] > 20 and ways[False, False, False] > 5000
