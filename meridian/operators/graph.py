"""Graph walks over edge tables: breadth-first levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.runtime import cut


def levels(edges: DataFrame, source: str, target: str, roots: DataFrame, depth: int) -> DataFrame:
    """(node, level) of what ``roots`` (column node) reach in at most ``depth`` steps, the least level each.

    The frontier alone is joined at a step; nodes met before are dropped by an anti join.
    """
    links = edges.select(F.col(source).alias("node"), F.col(target).alias("next")).dropna().distinct()
    seen = cut(roots.select("node").dropna().distinct().withColumn("level", F.lit(0)))
    frontier = seen
    for step in range(1, depth + 1):
        frontier = cut(frontier.join(links, "node").select(F.col("next").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("level", F.lit(step)))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    return seen


def groups(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): for every node of an undirected edge table the smallest node that it is linked to, itself included.

    Stars: a node's larger neighbours are hung on its least one, then its smaller ones, in turns,
    until nothing moves; a turn at least halves the height of what hangs together. Only distinct edges
    are ever kept, minima combine before their shuffles, and no group is gathered. Null ends and
    loops link nothing.
    """
    edges = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        wide = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        wide = cut(wide.where("u <> v").distinct())
        low = wide.groupBy("u").agg(F.min("v").alias("m"))
        near = wide.join(low, "u")
        edges = cut(near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
