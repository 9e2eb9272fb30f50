"""Points near points, and points in regions: triangles routed through a bounding-volume hierarchy.

Regions are polygons in degrees (x longitude, y latitude). Each is cut into triangles by ear
clipping. The top of the hierarchy is a tree of median cuts fitted on a bounded sample of the
points; every point falls in exactly one leaf, every triangle goes to each leaf that its box
meets. In a leaf a second hierarchy over the leaf's points is walked by all triangles at once,
and the points in a triangle's box are tested exactly. A point on a boundary shared by triangles
of one region is reported once: all its triangles meet it in the same leaf. Discs of a radius are
circumscribed octagons, and the great-circle distance decides in the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.functions.geo import haversine_m
from meridian.runtime import written

#: The tree's cuts are fitted on at most this many sampled points; every point is indexed.
SAMPLE_POINTS, SAMPLE_SUPPORT = 200_000, 16
#: Points that a leaf is meant to hold.
LEAF_POINTS = 4096
#: Below this box size a node of the hierarchy in a leaf is tested point by point.
NODE_POINTS = 8


def ear_clip(xs: np.ndarray, ys: np.ndarray) -> list[tuple[int, int, int]]:
    """Triangles, as vertex numbers, of a simple polygon of either orientation.

    A closing vertex equal to the first and repeated vertices are dropped; under three different
    vertices there are no triangles. A ring that crosses itself is cut as far as it has ears.
    """
    idx = [i for i in range(len(xs)) if i == 0 or (xs[i], ys[i]) != (xs[i - 1], ys[i - 1])]
    if len(idx) > 1 and (xs[idx[0]], ys[idx[0]]) == (xs[idx[-1]], ys[idx[-1]]):
        idx.pop()
    if len(idx) < 3:
        return []
    cross = lambda a, b, c: (xs[b] - xs[a]) * (ys[c] - ys[a]) - (ys[b] - ys[a]) * (xs[c] - xs[a])
    if sum(xs[a] * ys[b] - xs[b] * ys[a] for a, b in zip(idx, idx[1:] + idx[:1])) < 0:
        idx.reverse()
    out = []
    while len(idx) > 3:
        for k in range(len(idx)):
            a, b, c = idx[k - 1], idx[k], idx[(k + 1) % len(idx)]
            if cross(a, b, c) <= 0:
                continue
            inside = (p for p in idx if p not in (a, b, c) and (xs[p], ys[p]) not in ((xs[a], ys[a]), (xs[b], ys[b]), (xs[c], ys[c])))
            if any(cross(a, b, p) >= 0 and cross(b, c, p) >= 0 and cross(c, a, p) >= 0 for p in inside):
                continue
            out.append((a, b, c))
            idx.pop(k)
            break
        else:  # only flat corners, or a ring that crosses itself
            flat = next((k for k in range(len(idx)) if cross(idx[k - 1], idx[k], idx[(k + 1) % len(idx)]) == 0), None)
            if flat is None:
                return out
            idx.pop(flat)
    if cross(*idx) > 0:
        out.append(tuple(idx))
    return out


def triangles_of(polygons: DataFrame, key: str, ring: str) -> DataFrame:
    """(region, x1 .. y3) of polygons whose ``ring`` is an array of struct(x, y); null rings give none."""

    def cutter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for region, points in zip(pdf["region"], pdf["ring"]):
                if points is None or any(p is None or p["x"] is None or p["y"] is None for p in points):
                    continue
                xs, ys = np.array([p["x"] for p in points], float), np.array([p["y"] for p in points], float)
                rows += [(region, *(v for i in t for v in (xs[i], ys[i]))) for t in ear_clip(xs, ys)]
            yield pd.DataFrame(rows, columns=["region", "x1", "y1", "x2", "y2", "x3", "y3"])

    kind = polygons.schema[key].dataType.simpleString()
    source = polygons.select(F.col(key).alias("region"), F.col(ring).alias("ring"))
    return source.mapInPandas(cutter, f"region {kind}, x1 double, y1 double, x2 double, y2 double, x3 double, y3 double")


class Tree:
    """Median cuts of a point sample: node k has children 2k+1 and 2k+2; leaves are numbered by node.

    The sample bounds how many cuts it supports, ``SAMPLE_SUPPORT`` points each. Where more leaves are wanted, each
    is cut further into equal cells of the box that its sample fills, as many as are needed; what lies
    outside the box belongs to the cells at its edge.
    """

    def __init__(self, xy: np.ndarray, leaves: int) -> None:
        fitted = max(1, min(leaves, len(xy) // SAMPLE_SUPPORT))
        self.depth = max(0, math.ceil(math.log2(fitted)))
        self.cells = math.ceil(math.sqrt(max(1, leaves) / 2**self.depth))  # along each side of a leaf
        size = 2**self.depth - 1
        self.axis, self.at = np.zeros(size, np.int8), np.zeros(size)
        parts = {0: xy}
        for k in range(size):
            part = parts.pop(k)
            axis = int(np.argmax(np.ptp(part, axis=0))) if len(part) else 0
            at = float(np.median(part[:, axis])) if len(part) else 0.0
            self.axis[k], self.at[k] = axis, at
            left = part[:, axis] < at
            parts[2 * k + 1], parts[2 * k + 2] = part[left], part[~left]
        self.low, self.step = np.zeros((2**self.depth, 2)), np.ones((2**self.depth, 2))
        for k, part in parts.items():
            if len(part):
                self.low[k - size], wide = part.min(0), np.ptp(part, axis=0)
                self.step[k - size] = np.where(wide > 0, wide, 1.0) / self.cells

    def _cell(self, node: np.ndarray, v: np.ndarray, axis: int) -> np.ndarray:
        leaf = node - (2**self.depth - 1)
        return np.clip(np.floor((v - self.low[leaf, axis]) / self.step[leaf, axis]), 0, self.cells - 1).astype(np.int64)

    def leaf_of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            v = np.where(self.axis[node] == 0, x, y)
            node = 2 * node + 1 + (v >= self.at[node])
        return (node * self.cells + self._cell(node, y, 1)) * self.cells + self._cell(node, x, 0)

    def leaves_of(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that the boxes meet, borders included."""
        row, node = np.arange(len(lo)), np.zeros(len(lo), np.int64)
        for _ in range(self.depth):
            axis, at = self.axis[node], self.at[node]
            left, right = lo[row, axis] <= at, hi[row, axis] >= at
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
        for axis in (1, 0):
            first, last = (self._cell(node // self.cells ** (1 - axis), side[row, axis], axis) for side in (lo, hi))
            count = last - first + 1
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            row, node = np.repeat(row, count), np.repeat(node * self.cells + first, count) + at
        return row, node


def _walk(px: np.ndarray, py: np.ndarray, tri: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(triangle, point) of all points in the closed triangles, through a hierarchy of boxes."""
    n = len(px)
    depth = max(0, math.ceil(math.log2(max(1, n / NODE_POINTS))))
    order, bounds = np.arange(n), [(0, n)]
    for _ in range(depth):
        nxt = []
        for a, b in bounds:
            part = order[a:b]
            mid = (b - a) // 2
            if b - a > 1:
                v = px[part] if np.ptp(px[part]) >= np.ptp(py[part]) else py[part]
                order[a:b] = part[np.argpartition(v, mid)]
            nxt += [(a, a + mid), (a + mid, b)]
        bounds = nxt
    xs, ys = px[order], py[order]
    starts, ends = np.array([a for a, _ in bounds]), np.array([b for _, b in bounds])
    inf = np.inf
    boxes = [np.array([(xs[a:b].min(), ys[a:b].min(), xs[a:b].max(), ys[a:b].max()) if b > a else (inf, inf, -inf, -inf) for a, b in bounds])]
    while len(boxes[0]) > 1:
        low = boxes[0]
        boxes.insert(0, np.concatenate([np.minimum(low[::2, :2], low[1::2, :2]), np.maximum(low[::2, 2:], low[1::2, 2:])], axis=1))
    lo, hi = np.stack([tri[:, 0::2].min(1), tri[:, 1::2].min(1)], 1), np.stack([tri[:, 0::2].max(1), tri[:, 1::2].max(1)], 1)
    t, node = np.arange(len(tri)), np.zeros(len(tri), np.int64)
    for level, box in enumerate(boxes):
        if level:
            t, node = np.repeat(t, 2), np.stack([2 * node, 2 * node + 1], 1).ravel()
        hit = box[node]
        keep = (lo[t, 0] <= hit[:, 2]) & (hi[t, 0] >= hit[:, 0]) & (lo[t, 1] <= hit[:, 3]) & (hi[t, 1] >= hit[:, 1])
        t, node = t[keep], node[keep]
    count = ends[node] - starts[node]
    t = np.repeat(t, count)
    p = np.repeat(starts[node] - np.concatenate([[0], np.cumsum(count)[:-1]]) if len(count) else count, count) + np.arange(count.sum())
    x, y, c = xs[p], ys[p], tri[t]
    side = lambda ax, ay, bx, by: (bx - ax) * (y - ay) - (by - ay) * (x - ax)
    s = np.stack([side(c[:, 0], c[:, 1], c[:, 2], c[:, 3]), side(c[:, 2], c[:, 3], c[:, 4], c[:, 5]), side(c[:, 4], c[:, 5], c[:, 0], c[:, 1])])
    slack = 1e-15
    inside = (s >= -slack).all(0) | (s <= slack).all(0)
    return t[inside], order[p[inside]]


def in_triangles(points: DataFrame, triangles: DataFrame, leaf_points: int = LEAF_POINTS) -> DataFrame:
    """(region, px, py) once for every point (px, py) in a triangle of ``region``.

    ``points`` has different x, y; ``triangles`` has region, x1 .. y3. Empty inputs give no rows.
    """
    total = points.count()
    share = min(1.0, SAMPLE_POINTS / max(1, total))
    sample = points.select("x", "y") if share == 1.0 else points.select("x", "y").sample(share * 0.9, seed=17)
    xy = sample.limit(SAMPLE_POINTS).toPandas().to_numpy(float).reshape(-1, 2)
    tree = Tree(xy, math.ceil(total / leaf_points))  # a few numbers for each leaf, sent with the functions
    region_type = triangles.schema["region"].dataType.simpleString()

    def route_points(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(leaf=tree.leaf_of(pdf["x"].to_numpy(), pdf["y"].to_numpy()))

    corners = ["x1", "y1", "x2", "y2", "x3", "y3"]

    def route_triangles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            c = pdf[corners].to_numpy()
            row, leaf = tree.leaves_of(np.stack([c[:, 0::2].min(1), c[:, 1::2].min(1)], 1), np.stack([c[:, 0::2].max(1), c[:, 1::2].max(1)], 1))
            yield pdf.iloc[row].assign(leaf=leaf)

    def meet(pts: pd.DataFrame, tri: pd.DataFrame) -> pd.DataFrame:
        if not len(pts) or not len(tri):
            return pd.DataFrame({"region": tri["region"].iloc[:0], "px": pts["x"].iloc[:0], "py": pts["y"].iloc[:0]})
        px, py = pts["x"].to_numpy(), pts["y"].to_numpy()
        code, regions = pd.factorize(tri["region"])
        t, p = _walk(px, py, tri[corners].to_numpy())
        pairs = np.unique(code[t].astype(np.int64) * len(px) + p)
        r, p = pairs // len(px), pairs % len(px)
        return pd.DataFrame({"region": np.asarray(regions)[r], "px": px[p], "py": py[p]})

    routed = points.select("x", "y").mapInPandas(route_points, "x double, y double, leaf long")
    cut = triangles.select("region", *corners).mapInPandas(route_triangles, f"region {region_type}, x1 double, y1 double, x2 double, y2 double, x3 double, y3 double, leaf long")
    return routed.groupBy("leaf").cogroup(cut.groupBy("leaf")).applyInPandas(meet, f"region {region_type}, px double, py double")


def regions_of(points: DataFrame, x: str, y: str, polygons: DataFrame, key: str, ring: str, region: str = "assigned_region") -> DataFrame:
    """Every row of ``points`` with the key of each polygon that holds it, in a column named by ``region``.

    Points on a border belong to every region that has the border. Rows with null or NaN positions
    and rows in no region are left out; repeated rows come out as often as they went in.
    """
    spots = points.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)).select((F.col(x) + 0.0).alias("x"), (F.col(y) + 0.0).alias("y")).distinct()
    hits = in_triangles(spots, triangles_of(polygons, key, ring)).withColumnsRenamed({"px": "__px", "py": "__py", "region": "__region"})
    return points.join(hits, (F.col(x) + 0.0 == F.col("__px")) & (F.col(y) + 0.0 == F.col("__py"))).withColumn(region, F.col("__region")).drop("__px", "__py", "__region")


def _octagon() -> tuple[np.ndarray, np.ndarray]:
    turn = np.arange(8) * math.pi / 4 + math.pi / 8
    return np.cos(turn) / math.cos(math.pi / 8), np.sin(turn) / math.cos(math.pi / 8)


def _disc_triangles(spots: DataFrame, metres: float, radius: float) -> DataFrame:
    """Triangles of octagons around every disc, in degrees; discs over ±180° twice, at poles a band."""
    xs, ys = _octagon()
    reach = math.degrees(metres / radius) * (1 + 1e-6)
    far = F.abs(F.col("y")) + F.lit(reach)
    # The widest longitude of a small circle is asin(sin r / cos lat); the octagon's own margin covers rounding.
    wide = F.degrees(F.asin(F.sin(F.radians(F.lit(reach))) / F.cos(F.radians("y")))) * (1 + 1e-6)

    def corner(i: int) -> list[Column]:
        return [F.col("cx") + wide * float(xs[i]), F.col("y") + F.lit(reach * float(ys[i]))]

    around = spots.where(far < 89.0).withColumn("cx", F.explode(F.filter(F.array(F.col("x"), F.col("x") - 360, F.col("x") + 360), lambda c: (c + 2 * wide > -180) & (c - 2 * wide < 180))))
    cuts = F.array(*(F.struct(*(v.alias(n) for n, v in zip(("x1", "y1", "x2", "y2", "x3", "y3"), corner(a) + corner(b) + corner(c)))) for a, b, c in ear_clip(xs, ys)))
    near = around.select("region", F.inline(cuts))
    low, high = F.col("y") - F.lit(reach), F.col("y") + F.lit(reach)
    left, right = F.lit(-180.0), F.lit(180.0)
    halves = F.array(*(F.struct(*(v.alias(n) for n, v in zip(("x1", "y1", "x2", "y2", "x3", "y3"), t))) for t in ([left, low, right, low, right, high], [left, low, right, high, left, high])))
    return near.unionByName(spots.where(far >= 89.0).select("region", F.inline(halves)))


def pairs_within(rows: DataFrame, key: str, lat: str, lon: str, metres: float, radius: float) -> DataFrame:
    """(key_a, key_b) of all different keys at most ``metres`` apart on a sphere, key_a < key_b.

    Left out: null keys, null or NaN positions, latitudes beyond ±90, longitudes beyond ±180, and
    the placeholder at latitude and longitude 0. Repeated rows count once; a key with several
    positions is near what any of them is near. Rows at one position are one point of the index,
    and only come apart in the result.
    """
    y, x = F.col(lat).cast("double"), F.col(lon).cast("double")
    sound = y.isNotNull() & x.isNotNull() & ~F.isnan(y) & ~F.isnan(x) & (F.abs(y) <= 90) & (F.abs(x) <= 180) & ~((y == 0) & (x == 0)) & F.col(key).isNotNull()
    placed = written(rows.where(sound).select(F.col(key).alias("key"), (y + 0.0).alias("y"), (x + 0.0).alias("x")).distinct(), "placed")
    spots = written(placed.select("x", "y").distinct(), "spots")
    discs = spots.withColumn("region", F.struct("x", "y"))
    flat = _disc_triangles(discs, metres, radius).withColumns({"rx": F.col("region.x"), "ry": F.col("region.y")})
    flat = flat.withColumn("region", F.concat_ws("|", F.col("rx").cast("string"), F.col("ry").cast("string"))).drop("rx", "ry")
    hits = in_triangles(spots, flat)
    part = F.split("region", r"\|")
    hits = hits.select(part[0].cast("double").alias("ax"), part[1].cast("double").alias("ay"), F.col("px").alias("bx"), F.col("py").alias("by"))
    hits = hits.where((F.col("ax") < F.col("bx")) | ((F.col("ax") == F.col("bx")) & (F.col("ay") < F.col("by"))))
    hits = hits.where(haversine_m("ay", "ax", "by", "bx", radius) <= metres)
    a = placed.select(F.col("key").alias("ka"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = placed.select(F.col("key").alias("kb"), F.col("x").alias("bx"), F.col("y").alias("by"))
    apart = hits.join(a, ["ax", "ay"]).join(b, ["bx", "by"]).where("ka <> kb").select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b"))
    same = a.join(b, (F.col("ax") == F.col("bx")) & (F.col("ay") == F.col("by")) & (F.col("ka") < F.col("kb"))).select(F.col("ka").alias("key_a"), F.col("kb").alias("key_b"))
    return apart.unionByName(same).distinct()
