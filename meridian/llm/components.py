"""Groups from pairwise matches: connected components by deterministic Boruvka hooking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.runtime import cut


def _clean(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.nullif(F.lower(F.trim(c.cast("string"))), F.lit(""))


def components(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """(group_id, id) of every id that a pair links to another id.

    Ids are trimmed and lower-cased. Null and blank ids, and pairs of an id with itself, link
    nothing; repeated and reversed pairs count once; no pairs give no rows; further columns are
    ignored. ``group_id`` is the smallest id of the group.

    Each round, every component takes its smallest outgoing edge, that is its smallest
    neighbour, and the smaller of two components that chose each other is the root. The
    hooked trees collapse by pointer doubling, edges are relabelled and made distinct, and
    the rounds end when no edge is left. A round at least halves the components that still
    have edges. Nothing but one row's counters comes to the driver. A component of any size
    is only ever rows of (id, parent): min() is combined before the shuffle, so a hub needs
    no task of its own. Joins on parents are skewed to roots, which adaptive execution splits.
    """
    edges = (
        pairs.select(_clean(left).alias("a"), _clean(right).alias("b"))
        .where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    edges = cut(edges)
    ends = lambda e: e.select(F.col("a").alias("id"), F.col("b").alias("near")).unionByName(e.select(F.col("b").alias("id"), F.col("a").alias("near")))
    labels = cut(ends(edges).select("id").distinct().withColumn("root", F.col("id")))
    while not edges.isEmpty():
        hooks = ends(edges).groupBy("id").agg(F.min("near").alias("parent"))
        # Two components that chose each other: the smaller one becomes the root.
        other = hooks.select(F.col("id").alias("parent"), F.col("parent").alias("grand"))
        hooks = hooks.join(other, "parent", "left").select("id", F.when((F.col("grand") == F.col("id")) & (F.col("id") < F.col("parent")), F.col("id")).otherwise(F.col("parent")).alias("parent"))
        hooks = collapse(hooks)
        at = hooks.select(F.col("id").alias("root"), F.col("parent").alias("to"))
        labels = cut(labels.join(at, "root", "left").select("id", F.coalesce("to", "root").alias("root")))
        first, second = (hooks.select(F.col("id").alias(x), F.col("parent").alias(f"{x}{x}")) for x in "ab")
        edges = cut(
            edges.join(first, "a").join(second, "b")
            .select(F.least("aa", "bb").alias("a"), F.greatest("aa", "bb").alias("b"))
            .where("a <> b")
            .distinct()
        )
    names = labels.groupBy("root").agg(F.min("id").alias("group_id"))
    return labels.join(names, "root").select("group_id", "id")


def collapse(hooks: DataFrame) -> DataFrame:
    """The forest (id, parent), whose roots are their own parents, with every parent a root.

    Pointer doubling: the number of rounds is the logarithm of the greatest depth.
    """
    while True:
        hooks = cut(hooks)
        up = hooks.select(F.col("id").alias("parent"), F.col("parent").alias("grand"))
        lifted = hooks.join(up, "parent").select("id", "parent", "grand")
        if lifted.where("parent <> grand").isEmpty():
            return hooks
        hooks = lifted.select("id", F.col("grand").alias("parent"))
