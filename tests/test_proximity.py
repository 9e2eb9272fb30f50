import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meridian.operators import proximity
from meridian.operators.proximity import Tree, ear_clip, pairs_within, regions_of

R = 6_371_000.0


def metres(a, b):
    (y1, x1), (y2, x2) = ([math.radians(v) for v in p] for p in (a, b))
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * R * math.asin(math.sqrt(min(1, h)))


def sound(p):
    return None not in p and not any(math.isnan(v) for v in p) and abs(p[0]) <= 90 and abs(p[1]) <= 180 and p != (0.0, 0.0)


def points(seed):
    rng = random.Random(seed)
    out = []
    for cy, cx in ((51.0, -1.8), (89.9995, 10.0), (-89.999, -170.0), (0.0, 179.9995), (60.0, -179.9999), (0.001, 0.001)):
        out += [(max(-90, min(90, cy + rng.gauss(0, 0.001))), (cx + rng.gauss(0, 0.002) + 180) % 360 - 180) for _ in range(40)]
    out += [(90.0, 5.0), (90.0, -120.0), (-90.0, 0.0), (0.0, 180.0), (0.0, -180.0), (51.0, -1.8), (51.0, -1.8)]
    return out


def test_pairs_equal_brute_force_with_poles_date_line_and_dirt(spark):
    rows = [(f"k{i:04d}", float(y), float(x), "x") for i, (y, x) in enumerate(points(1))]
    rows += [("k0000", *rows[0][1:]), ("n1", None, 1.0, ""), ("n2", 1.0, None, ""), ("n3", math.nan, 7.0, ""), ("n4", 999.0, 12.0, None), ("n5", -91.0, 200.0, ""), ("n6", 0.0, 0.0, ""), ("n7", 0.0, 0.0, ""), (None, 51.0, -1.8, "")]
    df = spark.createDataFrame(rows, "id string, lat double, lon double, region string")
    got = {(r.key_a, r.key_b) for r in pairs_within(df, "id", "lat", "lon", 200.0, R).collect()}
    kept = sorted({(k, y, x) for k, y, x, _ in rows if k and sound((y, x))})
    want = {(a[0], b[0]) for i, a in enumerate(kept) for b in kept[i + 1 :] if a[0] != b[0] and metres(a[1:], b[1:]) <= 200}
    assert got == want and len(want) > 500


def test_pairs_of_nothing(spark):
    df = spark.createDataFrame([], "id string, lat double, lon double")
    assert pairs_within(df, "id", "lat", "lon", 200.0, R).count() == 0


def test_many_rows_at_one_position_are_one_point_of_the_index(spark):
    df = spark.createDataFrame([(i, 10.0, 10.0) for i in range(40)], "id long, lat double, lon double")
    assert pairs_within(df, "id", "lat", "lon", 200.0, R).count() == 40 * 39 // 2


@settings(max_examples=60, deadline=None)
@given(st.integers(3, 14), st.integers(0, 10_000))
def test_ears_cover_the_polygon(n, seed):
    rng = np.random.default_rng(seed)
    turn, r = np.sort(rng.choice(360, n, replace=False)) * math.pi / 180, rng.uniform(0.3, 2, n)
    if np.max(np.diff(np.concatenate([turn, [turn[0] + 2 * math.pi]]))) > 3.0:
        return
    xs, ys = r * np.cos(turn), r * np.sin(turn)
    area = lambda i: abs((xs[i[1]] - xs[i[0]]) * (ys[i[2]] - ys[i[0]]) - (ys[i[1]] - ys[i[0]]) * (xs[i[2]] - xs[i[0]])) / 2
    whole = abs(sum(xs[i] * ys[(i + 1) % n] - xs[(i + 1) % n] * ys[i] for i in range(n))) / 2
    assert sum(map(area, ear_clip(xs, ys))) == pytest.approx(whole)


def test_regions_share_borders_once_each_and_clashing_columns(spark):
    ring = lambda *p: [(float(x), float(y)) for x, y in p]
    shapes = [("square", ring((0, 0), (2, 0), (2, 2), (0, 2))), ("right", ring((2, 0), (4, 0), (4, 2), (2, 2), (2, 0))), ("L", ring((0, 2), (4, 2), (4, 3), (1, 3), (1, 4), (0, 4))), ("flat", ring((0, 0), (1, 1))), ("none", None)]
    polygons = spark.createDataFrame(shapes, "name string, ring array<struct<x:double,y:double>>")
    pts = [(1, 1.0, 1.0), (2, 2.0, 1.0), (3, 2.0, 2.0), (4, 3.0, 3.5), (5, 0.5, 3.9), (6, None, 1.0), (7, math.nan, 1.0), (1, 1.0, 1.0)]
    df = spark.createDataFrame([(*p, "was", 1, 2) for p in pts], "id int, x double, y double, region string, leaf int, px int")
    got = sorted((r.id, r.assigned_region, r.region) for r in regions_of(df, "x", "y", polygons, "name", "ring").collect())
    assert got == [(1, "square", "was"), (1, "square", "was"), (2, "right", "was"), (2, "square", "was"), (3, "L", "was"), (3, "right", "was"), (3, "square", "was"), (5, "L", "was")]
    assert regions_of(df.limit(0), "x", "y", polygons, "name", "ring").count() == 0


@given(st.integers(0, 10_000), st.sampled_from([1, 7, 60, 900]))
@settings(max_examples=25, deadline=None)
def test_leaves_beyond_the_sample_hold_what_their_boxes_meet(seed, leaves):
    rng = np.random.default_rng(seed)
    tree = Tree(np.round(rng.normal(0, 1, (100, 2)), 1), leaves)
    assert 2**tree.depth * tree.cells**2 >= leaves and 2**tree.depth <= 8
    p = rng.normal(0, 1.5, (60, 2))
    lo, hi = p - rng.random((60, 2)) * 0.3, p + rng.random((60, 2)) * 0.3
    row, leaf = tree.leaves_of(lo, hi)
    assert len({(r, k) for r, k in zip(row, leaf)}) == len(row)
    own = tree.leaf_of(p[:, 0], p[:, 1])
    for i in range(60):
        met = set(leaf[row == i])
        for j in range(60):
            if (lo[i] <= p[j]).all() and (p[j] <= hi[i]).all():
                assert own[j] in met


def test_pairs_with_many_more_leaves_than_the_sample_supports(spark, monkeypatch):
    rows = [(f"k{i:04d}", float(y), float(x)) for i, (y, x) in enumerate(points(3))]
    df = spark.createDataFrame(rows, "id string, lat double, lon double")
    want = {(r.key_a, r.key_b) for r in pairs_within(df, "id", "lat", "lon", 200.0, R).collect()}
    monkeypatch.setattr(proximity, "SAMPLE_POINTS", 60)
    monkeypatch.setattr(proximity.in_triangles, "__defaults__", (4,))
    assert {(r.key_a, r.key_b) for r in pairs_within(df, "id", "lat", "lon", 200.0, R).collect()} == want and want
