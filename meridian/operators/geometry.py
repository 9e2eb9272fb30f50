"""Planar and projective geometry over groups of points, and grids."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fit_homography(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray | None:
    """The 3x3 map of (x, y) to (u, v) by normalised direct linear transformation; None if degenerate."""
    if len(x) < 4:
        return None

    def scaled(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        centre = p.mean(0)
        spread = np.linalg.norm(p - centre, axis=1).mean()
        s = math.sqrt(2) / spread if spread > 0 else 1.0
        t = np.array([[s, 0, -s * centre[0]], [0, s, -s * centre[1]], [0, 0, 1]])
        return (p - centre) * s, t

    (a, ta), (b, tb) = scaled(np.stack([x, y], 1)), scaled(np.stack([u, v], 1))
    zero, one = np.zeros(len(a)), np.ones(len(a))
    top = np.stack([a[:, 0], a[:, 1], one, zero, zero, zero, -b[:, 0] * a[:, 0], -b[:, 0] * a[:, 1], -b[:, 0]], 1)
    low = np.stack([zero, zero, zero, a[:, 0], a[:, 1], one, -b[:, 1] * a[:, 0], -b[:, 1] * a[:, 1], -b[:, 1]], 1)
    _, s, vt = np.linalg.svd(np.concatenate([top, low]))
    if s[7] < 1e-9 * s[0]:
        return None
    h = np.linalg.inv(tb) @ vt[-1].reshape(3, 3) @ ta
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else None


def _solved(kind: str, n: int, sums: dict, ta: np.ndarray, tb: np.ndarray) -> np.ndarray | None:
    """The map of normalised points from the sums of their products, ``ta`` and ``tb`` undone; None if degenerate."""
    p = {w: np.array([[sums[f"{w}_{a}{b}" if a <= b else f"{w}_{b}{a}"] for b in range(3)] for a in range(3)], float) for w in ("o", "u", "v", "q")}
    if n < (4 if kind == "homography" else 3) or not all(np.isfinite(m).all() for m in p.values()):
        return None
    if kind == "homography":
        zero = np.zeros((3, 3))
        values, vectors = np.linalg.eigh(np.block([[p["o"], zero, -p["u"]], [zero, p["o"], -p["v"]], [-p["u"], -p["v"], p["q"]]]))
        if values[1] < 1e-13 * values[-1]:
            return None
        h = np.linalg.inv(tb) @ vectors[:, 0].reshape(3, 3) @ ta
        return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else None
    values = np.linalg.eigvalsh(p["o"])
    if values[0] < 1e-13 * values[-1]:
        return None
    h = np.vstack([np.linalg.solve(p["o"], np.stack([p["u"][2], p["v"][2]], 1)).T, [0, 0, 1]])
    return np.linalg.inv(tb) @ h @ ta


def fit_maps(points: DataFrame, by: Sequence[str], kind: str = "homography") -> DataFrame:
    """(by, map, rmse, n): homography or affine map of each group's (x, y) to (u, v), nine numbers by rows.

    Null where a group has too few points or they are degenerate (a ten-millionth of their spread off a line,
    say). Sums of products of the normalised points are aggregated over all rows; no group is gathered.
    """
    kinds = points.select(*by).schema.simpleString()[len("struct<") : -1].replace(":", " ")
    points = points.where("x IS NOT NULL AND y IS NOT NULL AND u IS NOT NULL AND v IS NOT NULL").select(*by, *(F.col(c).cast("double").alias(c) for c in "xyuv"))

    def joined(rows: DataFrame, groups: DataFrame) -> DataFrame:
        side = groups.withColumnsRenamed({c: f"__by{i}" for i, c in enumerate(by)})
        same = [F.col(c).eqNullSafe(F.col(f"__by{i}")) for i, c in enumerate(by)]
        return rows.join(side, reduce(and_, same)).drop(*(f"__by{i}" for i in range(len(by))))

    def norm(a: Column, b: Column) -> Column:
        return F.sqrt(a * a + b * b)

    centres = points.groupBy(*by).agg(*(F.avg(c).alias(f"m{c}") for c in "xyuv"))
    spreads = joined(points, centres).groupBy(*by).agg(*(F.first(f"m{c}").alias(f"m{c}") for c in "xyuv"), *(F.avg(norm(F.col(a) - F.col(f"m{a}"), F.col(b) - F.col(f"m{b}"))).alias(f"d{a}") for a, b in ("xy", "uv")))
    stats = spreads.select(*by, *(f"m{c}" for c in "xyuv"), *(F.when(F.col(f"d{a}") > 0, F.lit(math.sqrt(2)) / F.when(F.col(f"d{a}") > 0, F.col(f"d{a}"))).otherwise(1.0).alias(f"s{a}") for a in "xu"))
    x, y, u, v = ((F.col(c) - F.col(f"m{c}")) * F.col(f"s{s}") for c, s in zip("xyuv", "xxuu"))
    p, weights = [x, y, F.lit(1.0)], {"o": F.lit(1.0), "u": u, "v": v, "q": u * u + v * v}
    keep = [f"m{c}" for c in "xyuv"] + ["sx", "su"]
    sums = joined(points, stats).groupBy(*by).agg(F.count("*").cast("int").alias("n"), *(F.first(c).alias(c) for c in keep), *(F.sum(w * p[a] * p[b]).alias(f"{k}_{a}{b}") for k, w in weights.items() for a in range(3) for b in range(a, 3)))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            maps = []
            for r in pdf.to_dict("records"):
                ta, tb = (np.array([[r[s], 0, -r[s] * r[a]], [0, r[s], -r[s] * r[b]], [0, 0, 1]]) for s, a, b in (("sx", "mx", "my"), ("su", "mu", "mv")))
                h = _solved(kind, r["n"], r, ta, tb)
                maps.append(None if h is None else h.ravel().tolist())
            yield pdf[[*by, "n"]].assign(map=pd.Series(maps, index=pdf.index, dtype=object))

    maps = sums.mapInPandas(solve, f"{kinds}, n int, map array<double>")
    to_u, to_v = apply_map(F.col("map"), F.col("x"), F.col("y"))
    off = F.coalesce((to_u - F.col("u")) ** 2 + (to_v - F.col("v")) ** 2, F.lit(float("inf")))
    fits = joined(points, maps).groupBy(*by).agg(F.first("map").alias("map"), F.sqrt(F.avg(F.when(F.col("map").isNotNull(), off))).alias("rmse"), F.first("n").alias("n"))
    return fits.select(*by, "map", "rmse", "n")


def apply_map(h: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """(u, v) of (x, y) under nine numbers by rows; null on the horizon."""
    at = lambda i: F.get(h, F.lit(i))
    w = at(6) * x + at(7) * y + at(8)
    return F.try_divide(at(0) * x + at(1) * y + at(2), w), F.try_divide(at(3) * x + at(4) * y + at(5), w)


def convex(xs: Sequence[Column], ys: Sequence[Column]) -> Column:
    """Whether corners in order turn one way only, none of them flat."""
    n = len(xs)
    turn = [(xs[(i + 1) % n] - xs[i]) * (ys[(i + 2) % n] - ys[(i + 1) % n]) - (ys[(i + 1) % n] - ys[i]) * (xs[(i + 2) % n] - xs[(i + 1) % n]) for i in range(n)]
    return F.least(*turn) * F.greatest(*turn) > 0


def shoelace(xs: Sequence[Column], ys: Sequence[Column]) -> Column:
    n = len(xs)
    return F.abs(sum((xs[i] * ys[(i + 1) % n] - xs[(i + 1) % n] * ys[i] for i in range(n)), F.lit(0.0))) / 2


def tile_grid(rasters: DataFrame, key: str, width: str, height: str, size: int, step: int, scales: Sequence[float]) -> DataFrame:
    """(key, scale, col, row, x0, y0) of tiles that cover each raster, the last ones set to its edges.

    A raster smaller than a tile has one at 0; null or non-positive sizes have none. Tiles are
    generated where their raster is; no list of offsets is gathered.
    """
    offsets = lambda n, s: F.array_distinct(F.transform(F.sequence(F.lit(0), F.ceil(F.greatest(F.col(n) - s, F.lit(0)) / F.lit(step)).cast("int")), lambda i: F.least(i * step, F.greatest(F.col(n).cast("int") - s, F.lit(0)))))
    sized = rasters.where((F.col(width) > 0) & (F.col(height) > 0)).withColumn("scale", F.explode(F.array(*map(F.lit, scales))))
    side = (F.lit(size) * F.col("scale")).cast("int")
    return sized.select("*", F.posexplode(offsets(width, side)).alias("col", "x0")).select("*", F.posexplode(offsets(height, side)).alias("row", "y0")).select(key, "scale", "col", "row", "x0", "y0")


def grid_reference(ref: Column) -> tuple[Column, Column, Column]:
    """(easting, northing, resolution) in metres of a British grid reference, at the centre of its cell; null if it is none."""
    text = F.upper(F.regexp_replace(ref, r"\s+", ""))
    good = text.rlike(r"^[HJNOST][A-HJ-Z](\d\d){1,5}$")
    number = lambda i: F.ascii(F.substring(text, i, 1)) - 65 - (F.substring(text, i, 1) > "I").cast("int")
    big, small = number(1), number(2)
    digits = F.floor((F.length(text) - 2) / 2).cast("int")
    unit = F.pow(F.lit(10), 5 - digits)
    part = lambda start: F.expr("1").cast("double") * F.substring(text, start, digits).try_cast("double")
    east = ((F.pmod(big - 2, F.lit(5))) * 5 + F.pmod(small, F.lit(5))) * 100000 + part(F.lit(3)) * unit + unit / 2
    north = (19 - F.floor(big / 5) * 5 - F.floor(small / 5)) * 100000 + part(3 + digits) * unit + unit / 2
    return F.when(good, east), F.when(good, north), F.when(good, unit)


# Ellipsoid and projection of the British grid, and its datum's shift to WGS84.
AIRY, WGS84 = (6377563.396, 6356256.909), (6378137.0, 6356752.314245)
GRID = {"f0": 0.9996012717, "lat0": 49.0, "lon0": -2.0, "n0": -100000.0, "e0": 400000.0}
SHIFT = {"t": (446.448, -125.157, 542.060), "r": (0.1502, 0.2470, 0.8421), "s": -20.4894e-6}


def grid_to_wgs84(east: np.ndarray, north: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(latitude, longitude) of British grid coordinates, vectorised."""
    a, b = AIRY
    e2, n = 1 - b * b / (a * a), (a - b) / (a + b)
    lat0, lon0 = math.radians(GRID["lat0"]), math.radians(GRID["lon0"])

    def arc(lat: np.ndarray) -> np.ndarray:
        d, s = lat - lat0, lat + lat0
        return b * GRID["f0"] * ((1 + n + 1.25 * n**2 + 1.25 * n**3) * d - (3 * n + 3 * n**2 + 21 / 8 * n**3) * np.sin(d) * np.cos(s) + (15 / 8 * n**2 + 15 / 8 * n**3) * np.sin(2 * d) * np.cos(2 * s) - 35 / 24 * n**3 * np.sin(3 * d) * np.cos(3 * s))

    lat = np.full_like(north, lat0)
    for _ in range(12):
        lat = lat + (north - GRID["n0"] - arc(lat)) / (a * GRID["f0"])
    sin, cos, tan = np.sin(lat), np.cos(lat), np.tan(lat)
    nu = a * GRID["f0"] / np.sqrt(1 - e2 * sin**2)
    rho = a * GRID["f0"] * (1 - e2) / (1 - e2 * sin**2) ** 1.5
    eta = nu / rho - 1
    d = east - GRID["e0"]
    phi = lat - tan / (2 * rho * nu) * d**2 + tan / (24 * rho * nu**3) * (5 + 3 * tan**2 + eta - 9 * tan**2 * eta) * d**4 - tan / (720 * rho * nu**5) * (61 + 90 * tan**2 + 45 * tan**4) * d**6
    lam = lon0 + d / (cos * nu) - d**3 / (6 * cos * nu**3) * (nu / rho + 2 * tan**2) + d**5 / (120 * cos * nu**5) * (5 + 28 * tan**2 + 24 * tan**4) - d**7 / (5040 * cos * nu**7) * (61 + 662 * tan**2 + 1320 * tan**4 + 720 * tan**6)
    v = a / np.sqrt(1 - e2 * np.sin(phi) ** 2)
    p = np.stack([v * np.cos(phi) * np.cos(lam), v * np.cos(phi) * np.sin(lam), v * (1 - e2) * np.sin(phi)])
    rx, ry, rz = (math.radians(r / 3600) for r in SHIFT["r"])
    m = np.array([[1 + SHIFT["s"], -rz, ry], [rz, 1 + SHIFT["s"], -rx], [-ry, rx, 1 + SHIFT["s"]]])
    x, y, z = np.array(SHIFT["t"])[:, None] + m @ p.reshape(3, -1)
    a, b = WGS84
    e2 = 1 - b * b / (a * a)
    r = np.hypot(x, y)
    phi = np.arctan2(z, r * (1 - e2))
    for _ in range(8):
        v = a / np.sqrt(1 - e2 * np.sin(phi) ** 2)
        phi = np.arctan2(z + e2 * v * np.sin(phi), r)
    return np.degrees(phi), np.degrees(np.arctan2(y, x))


@F.pandas_udf(T.StructType([T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType())]))
def grid_position(east: pd.Series, north: pd.Series) -> pd.DataFrame:
    """WGS84 position of British grid metres; null for null."""
    e, n = east.to_numpy(float), north.to_numpy(float)
    lat, lon = grid_to_wgs84(np.nan_to_num(e, nan=400000.0), np.nan_to_num(n, nan=0.0))
    bad = np.isnan(e) | np.isnan(n)
    return pd.DataFrame({"latitude": np.where(bad, None, lat), "longitude": np.where(bad, None, lon)}).astype(float)


def screen_clusters(points: DataFrame, by: Sequence[str], radius: float) -> DataFrame:
    """(by, id, cluster): greedy clusters of (x, y), in order of x, y, id, each by its running centroid.

    A point joins the nearest centroid at most ``radius`` away, of equal ones the earliest, or
    founds a cluster. Of an id of a view the row of least x and y counts. The rule depends on order, so
    a view is one task; the task reads its points sorted, a batch at a time, and holds only the centroids
    that later points, whose x is no less, can still reach.
    """
    kinds = points.select(*by).schema.simpleString()[len("struct<") : -1].replace(":", " ")
    id_kind = points.schema["id"].dataType.simpleString()
    reach = radius * (1 + 1e-9)

    def greedy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        view, count = None, 0
        for pdf in batches:
            out = np.zeros(len(pdf), np.int32)
            for i, (v, x, y) in enumerate(zip(pdf["view__"], pdf["x"].to_numpy(float), pdf["y"].to_numpy(float))):
                if v != view:
                    view, count, cx, cy, n, label = v, 0, *np.zeros((4, 0))
                elif i % 512 == 0:
                    cx, cy, n, label = (c[cx + reach >= x] for c in (cx, cy, n, label))
                d = np.hypot(cx - x, cy - y)
                j = int(np.argmin(d)) if len(d) else -1
                if j < 0 or d[j] > radius:
                    count += 1
                    cx, cy, n, label = (np.append(c, z) for c, z in ((cx, 0.0), (cy, 0.0), (n, 0.0), (label, count)))
                    j = len(cx) - 1
                n[j] += 1
                cx[j] += (x - cx[j]) / n[j]
                cy[j] += (y - cy[j]) / n[j]
                out[i] = label[j]
            yield pdf[[*by, "id"]].assign(cluster=out)

    once = points.groupBy(*by, "id").agg(F.min(F.struct("x", "y")).alias("p")).select(*by, "id", "p.x", "p.y", F.to_json(F.struct(*by)).alias("view__"))
    return once.repartition("view__").sortWithinPartitions("view__", F.asc_nulls_last("x"), F.asc_nulls_last("y"), "id").mapInPandas(greedy, f"{kinds}, id {id_kind}, cluster int")
