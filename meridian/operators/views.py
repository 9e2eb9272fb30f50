"""What a map shows: clusters by zoom in a viewport, their sums, how they are drawn and what a click does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.operators.geometry import screen_clusters

# Greatest zoom, radius and buffer in pixels of each step.
STEPS = [(2, 32, 50), (4, 70, 70), (7, 90, 80), (10, 64, 70), (float("inf"), 18, 40)]


def settings(zoom: float) -> tuple[int, int]:
    """(radius, buffer) in pixels at a zoom."""
    return next((r, b) for top, r, b in STEPS if zoom <= top)


def view_clusters(points: DataFrame, zoom: float, width: int, height: int) -> DataFrame:
    """(cluster, reports, images, roles, south, west, north, east, wide, selected) of the points in a viewport and its buffer.

    ``points`` has id, x, y (pixels), lat, lon, images, role, selected; of an id the row of most images
    counts, selected if any is. What lies outside is left out before the one task that the greedy rule needs;
    that reads the points sorted, however many a screen shows. Roles are a sorted list of role=count.
    """
    radius, buffer = settings(zoom)
    shown = points.where(F.col("x").between(-buffer, width + buffer) & F.col("y").between(-buffer, height + buffer) & ~F.isnan("x") & ~F.isnan("y"))
    once = shown.groupBy("id").agg(F.min(F.struct((-F.col("images")).alias("less"), "x", "y", "lat", "lon", "role", "images")).alias("p"), F.max("selected").alias("selected"))
    rows = once.select("id", "p.x", "p.y", "p.lat", "p.lon", F.coalesce(F.nullif("p.role", F.lit("")), F.lit("unresolved")).alias("role"), "p.images", "selected")
    laid = screen_clusters(rows.select(F.lit(0).alias("view"), "id", "x", "y"), ["view"], float(radius)).select("id", "cluster")
    joined = rows.join(laid, "id")
    roles = joined.groupBy("cluster", "role").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("role", "n"))), lambda r: F.concat_ws("=", r["role"], r["n"].cast("string"))), ";").alias("roles"))
    spread = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))
    sums = joined.groupBy("cluster").agg(
        F.count("*").alias("reports"), F.sum("images").alias("images"), F.min("lat").alias("south"), F.min("lon").alias("west"), F.max("lat").alias("north"), F.max("lon").alias("east"), spread.alias("wide"), F.max("selected").alias("selected"),
    )
    return sums.join(roles, "cluster").select("cluster", "reports", "images", "roles", "south", "west", "north", "east", "wide", "selected")


def drawn_as(reports: Column, zoom: Column) -> tuple[Column, Column]:
    """(kind, size) of a marker: single ones from zoom 8 on, sizes at 10 and 50 reports."""
    return F.when((zoom <= 7) | (reports > 1), "cluster").otherwise("individual"), F.when(reports >= 50, "large").when(reports >= 10, "medium").otherwise("small")


def on_click(reports: Column, wide: Column, zoom: Column) -> Column:
    """What a click on a marker does: zoom, open_archive or choose."""
    return F.when(reports <= 1, F.when(zoom < 8, "zoom").otherwise("open_archive")).otherwise(F.when((wide > 8) & (zoom < 11), "zoom").otherwise("choose"))
