"""Keyed resolution: entities from assertions, survivors of repeats, unions and upserts.

Order is never a table's: every operator takes an ordinal, and ties end in it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_present(name: str, ordinal: Column) -> Column:
    """First value of a group that is neither null nor empty."""
    return F.min_by(F.when(F.col(name).cast("string") != "", F.col(name)), F.when(F.col(name).cast("string") != "", ordinal))


def last_present(name: str, ordinal: Column, among: Column) -> Column:
    """Last value, neither null nor empty, of a group's rows for which ``among`` holds."""
    keep = among & (F.col(name).cast("string") != "")
    return F.max_by(F.when(keep, F.col(name)), F.when(keep, ordinal))


def joined_set(x: Column, by: str = "; ") -> Column:
    """Distinct present values, sorted and joined."""
    return F.array_join(F.array_sort(F.collect_set(F.when(x.cast("string") != "", x))), by)


def keep_first(rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key; null keys are one key."""
    at = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(at)).where("__n = 1").drop("__n")


def strict_best(rows: DataFrame, keys: Sequence[str], score: str, tie: str) -> DataFrame:
    """Rows with the greatest score of their key, where no other row shares it; null scores are none.

    Two aggregations that combine before their shuffles, so a key with any share of the rows is no
    task of its own.
    """
    rest = [c for c in rows.columns if c not in (*keys, score)]
    same = rows.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.count("*").alias("__n"), F.min_by(F.struct(*rest), F.col(tie)).alias("__r"))
    best = same.groupBy(*keys).agg(F.max_by(F.struct(score, "__n", "__r"), F.col(score)).alias("__b")).where("__b.__n = 1")
    return best.select(*keys, F.col(f"__b.`{score}`").alias(score), *(F.col(f"__b.__r.`{c}`").alias(c) for c in rest)).select(*rows.columns)


def top_tier(rows: DataFrame, keys: Sequence[str], tier: str) -> DataFrame:
    """All rows of the least tier of their key, with the number of them as ``candidates``."""
    counts = rows.groupBy(*keys, tier).agg(F.count("*").alias("__n"))
    best = counts.groupBy(*keys).agg(F.min(F.struct(tier, "__n")).alias("__b"))
    best = best.select(*keys, F.col(f"__b.`{tier}`").alias(tier), F.col("__b.__n").alias("candidates"))
    return rows.join(best, [*keys, tier]).select(*rows.columns, "candidates")


def last_wins(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union of tables; of a key in several, the row of the last table."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (t.withColumn("__stage", F.lit(i)) for i, t in enumerate(tables)))
    others = [c for c in every.columns if c not in (*keys, "__stage")]
    best = every.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct("__stage", F.to_json(F.struct(*others)))).alias("__r"))
    return best.select(*keys, "__r.*")


def replace_managed(existing: DataFrame, generated: DataFrame, key: str) -> DataFrame:
    """Existing rows whose key was not generated again, and the generated ones."""
    return existing.join(generated.select(key), key, "left_anti").unionByName(generated)


def merge_aliases(entities: DataFrame, aliases: DataFrame, key: str, lists: Sequence[str]) -> DataFrame:
    """Entities without those that are aliases; the canonical one takes the aliases' delimited lists too.

    ``aliases`` has alias and canonical, each alias once. Lists keep their order, repeats dropped.
    """
    folded = aliases.join(entities, F.col("alias") == F.col(key)).groupBy("canonical").agg(*(F.array_sort(F.collect_list(F.struct("alias", F.col(c)))).alias(f"__{c}") for c in lists))
    kept = entities.join(aliases.select(F.col("alias").alias(key)), key, "left_anti").join(folded.withColumnRenamed("canonical", key), key, "left")
    own = lambda c: F.split(F.coalesce(F.col(c), F.lit("")), "; ")
    more = lambda c: F.coalesce(F.flatten(F.transform(f"__{c}", lambda x: F.split(F.coalesce(x[c], F.lit("")), "; "))), F.array().cast("array<string>"))
    return kept.withColumns({c: F.array_join(F.filter(F.array_distinct(F.concat(own(c), more(c))), lambda v: v != ""), "; ") for c in lists}).drop(*(f"__{c}" for c in lists))


def filled_slots(rows: DataFrame, keys: Sequence[str], promised: str) -> DataFrame:
    """(keys, slot) for the slots 1 .. ``promised`` of each key; none where nothing is promised."""
    return rows.where(F.col(promised) > 0).select(*keys, F.explode(F.sequence(F.lit(1), F.col(promised).cast("int"))).alias("slot"))
