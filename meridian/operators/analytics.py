"""Aggregates: marginals, confusion, circular statistics, errors, yields."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.runtime import written


def marginals(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(field, value, n): counts of the values of each column, in one pass; null is a value."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns)))
    return rows.select(pairs.alias("p")).groupBy("p.field", "p.value").agg(F.count("*").alias("n"))


def confusion(rows: DataFrame, truth: Column, said: Column, by: Sequence[str] = ()) -> DataFrame:
    """Counts tp, fp, fn, tn and accuracy, precision, recall, specificity, f1 to 4 places; null where undefined."""
    cell = lambda t, s: F.count_if((truth == F.lit(t)) & (said == F.lit(s)))
    counts = rows.groupBy(*by).agg(cell(True, True).alias("tp"), cell(False, True).alias("fp"), cell(True, False).alias("fn"), cell(False, False).alias("tn"))
    part = lambda a, b: F.round(F.try_divide(F.expr(a), F.expr(b)), 4)
    return counts.withColumns({"accuracy": part("tp + tn", "tp + fp + fn + tn"), "precision": part("tp", "tp + fp"), "recall": part("tp", "tp + fn"), "specificity": part("tn", "tn + fp"), "f1": part("2 * tp", "2 * tp + fp + fn")})


def axial_mean(rows: DataFrame, by: Sequence[str], angle: str, weight: str) -> DataFrame:
    """Weighted mean and deviation of axes (degrees modulo 180): axis_mean, axis_deviation, n.

    The deviation is about the mean; 90 where the weights sum to nothing. One aggregation: sums of
    the doubled angle give the mean, and the rows meet it in a join on the group.
    """
    double = F.radians(F.col(angle) * 2)
    sums = rows.groupBy(*by).agg(F.sum(F.col(weight) * F.sin(double)).alias("s"), F.sum(F.col(weight) * F.cos(double)).alias("c"), F.sum(weight).alias("__w"), F.count("*").alias("n"))
    mean = sums.withColumn("axis_mean", F.pmod(F.degrees(F.atan2("s", "c")) / 2, F.lit(180.0)))
    off = F.abs(F.pmod(F.col(angle) - F.col("axis_mean") + 90, F.lit(180.0)) - 90)
    spread = rows.join(mean, list(by)).groupBy(*by, "axis_mean", "__w", "n").agg(F.sum(F.col(weight) * off * off).alias("q"))
    return spread.select(*by, "axis_mean", F.when(F.col("__w") > 0, F.sqrt(F.col("q") / F.col("__w"))).otherwise(90.0).alias("axis_deviation"), "n")


def error_summary(rows: DataFrame, by: Sequence[str], error: str) -> DataFrame:
    """median, rmse, max and p95 of errors, exact and interpolated."""
    e = F.col(error)
    return rows.groupBy(*by).agg(F.percentile(e, F.lit(0.5)).alias("median_error"), F.sqrt(F.avg(e * e)).alias("rmse"), F.max(e).alias("max_error"), F.percentile(e, F.lit(0.95)).alias("p95_error"))


def recall_at(ranked: DataFrame, hit: Column, query: str, ks: Sequence[int]) -> DataFrame:
    """(k, recall): share of queries with a hit among their first k ranks."""
    first = ranked.groupBy(query).agg(F.min(F.when(hit, F.col("rank"))).alias("first"))
    ladder = F.explode(F.array(*map(F.lit, ks))).alias("k")
    return first.select("first", ladder).groupBy("k").agg(F.avg(F.when(F.col("first") <= F.col("k"), 1.0).otherwise(0.0)).alias("recall"))


def segment_clusters(rows: DataFrame, by: Sequence[str], angle: str, weight: str, near: float = 4.0, apart: float = 10.0) -> DataFrame:
    """Greedy axes of a group of weighted angles: (by, cluster, axis, support, members, deviation, longest).

    Every angle is a seed; its members are the angles within ``near`` degrees of it, modulo 180. The
    seed's axis is the members' weighted mean axis, its support their weight, its deviation theirs
    about that axis (90 where they weigh nothing), and longest their greatest weight. Seeds are kept from the strongest support, then
    the smallest axis, if their axis is more than ``apart`` from all kept ones. Null angles and
    weights count nothing; an empty table gives no rows. Rows of one exact angle are combined before
    the shuffle: a group's task holds its different angles and nothing that grows with their rows.
    """
    kinds = rows.select(*by).schema.simpleString()[len("struct<") : -1].replace(":", " ")
    own = F.pmod(F.col(angle).cast("double"), F.lit(180.0)).alias("a")
    angles = rows.where(F.col(angle).isNotNull() & F.col(weight).isNotNull()).groupBy(*by, own).agg(F.sum(F.col(weight).cast("double")).alias("w"), F.count("*").alias("n"), F.max(F.col(weight).cast("double")).alias("top"))

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("a")
        a, w, n, top = (pdf[c].to_numpy(float) for c in ("a", "w", "n", "top"))
        round_ = np.concatenate([a - 180, a, a + 180])
        wide = lambda v: np.concatenate([[0.0], np.cumsum(np.tile(v, 3))])
        low, high = np.searchsorted(round_, a - near - 1e-9), np.searchsorted(round_, a + near + 1e-9, "right")
        within = lambda v: wide(v)[high] - wide(v)[low]
        support, members = np.round(within(w), 9), within(n).astype(int)
        axis = np.degrees(np.arctan2(within(w * np.sin(np.radians(2 * a))), within(w * np.cos(np.radians(2 * a))))) / 2 % 180
        centre = a + (axis - a + 90) % 180 - 90  # the axis beside its seed, where no angle wraps
        x = np.concatenate([[0.0], np.cumsum(round_ * np.tile(w, 3))])
        xx = np.concatenate([[0.0], np.cumsum(round_**2 * np.tile(w, 3))])
        spread = (xx[high] - xx[low]) - 2 * centre * (x[high] - x[low]) + centre**2 * within(w)
        deviation = np.where(support > 0, np.sqrt(np.maximum(spread, 0) / np.where(support > 0, support, 1)), 90.0)
        longest = np.maximum.reduceat(np.append(np.tile(top, 3), -np.inf), np.stack([low, high], 1).ravel())[::2]
        axis = np.round(axis, 9) % 180
        kept: list[int] = []
        for i in np.lexsort((axis, -support)):
            if all(abs((axis[i] - axis[j] + 90) % 180 - 90) > apart for j in kept):
                kept.append(i)
        head = {c: [pdf[c].iloc[0]] * len(kept) for c in by}
        return pd.DataFrame(head | {"cluster": range(1, len(kept) + 1), "axis": axis[kept], "support": support[kept], "members": members[kept], "deviation": deviation[kept], "longest": longest[kept]})

    return angles.groupBy(*by).applyInPandas(greedy, f"{kinds}, cluster int, axis double, support double, members long, deviation double, longest double")


def carried(rows: DataFrame, by: Sequence[str], order: Sequence[Column], value: Column) -> DataFrame:
    """Adds ``carried``: the last present value up to a row, in its group's order."""
    frame = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("carried", F.last(value, ignorenulls=True).over(frame))


def ranked(rows: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Adds the place of each row, 1 to N, in one total order of the whole table; ``order`` should end in a key.

    Rows are spread by ranges of the order and written once; a range's first place is the rows of the
    ranges before it. So no task holds more than a range, however many rows there are.
    """
    ranges = written(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = {r["__range"]: r["count"] for r in ranges.groupBy("__range").count().collect()}
    before = [sum(n for p, n in sizes.items() if p < i) for i in range(max(sizes, default=0) + 1)]
    at = Window.partitionBy("__range").orderBy(*order)
    offset = F.get(F.array(*map(F.lit, before)).cast("array<bigint>"), F.col("__range"))
    return ranges.withColumn(name, F.row_number().over(at) + offset).drop("__range")
