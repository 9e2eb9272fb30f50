"""Choices and checks over keyed records: arg-max by tiers, flags, sequences, sets, nested checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_by(rows: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, Column]], keep: Sequence[str]) -> DataFrame:
    """(keys, names of order, keep) of the row that is least by ``order``, named ascending expressions, for each key.

    A minimum over a struct, combined before its shuffle; give descending order by a minus or a rank.
    """
    best = rows.groupBy(*keys).agg(F.min(F.struct(*(c.alias(n) for n, c in order), *(F.col(k).alias(f"__{k}") for k in keep))).alias("__b"))
    return best.select(*keys, *(F.col(f"__b.{n}").alias(n) for n, _ in order), *(F.col(f"__b.__{k}").alias(k) for k in keep))


def reasons(*rules: tuple[Column, str]) -> Column:
    """The reasons whose condition holds, in the order of the rules; a null condition does not hold."""
    return F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for c, r in rules)), lambda r: r.isNotNull())


def sets(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(left_only, shared, right_only, subset, disjoint, equal) of the different non-null keys of two tables, in one full join."""
    one = lambda df, n: df.where(F.col(key).isNotNull()).select(F.col(key)).distinct().withColumn(n, F.lit(True))
    joined = one(left, "__l").join(one(right, "__r"), key, "full")
    counts = joined.agg(F.count_if(F.col("__r").isNull()).alias("left_only"), F.count_if(F.col("__l") & F.col("__r")).alias("shared"), F.count_if(F.col("__l").isNull()).alias("right_only"))
    return counts.select("*", (F.col("left_only") == 0).alias("subset"), (F.col("shared") == 0).alias("disjoint"), ((F.col("left_only") == 0) & (F.col("right_only") == 0)).alias("equal"))


def upsert(existing: DataFrame, fresh: DataFrame, key: str, replace: bool) -> DataFrame:
    """``existing`` with the rows of ``fresh``; of a key in both the fresh row.

    Without ``replace`` a key that is there already is an error when the result is computed, not a silent change.
    """
    kept = existing.join(fresh.select(key), key, "left_anti")
    if replace:
        return kept.unionByName(fresh)
    there = existing.select(F.col(key).alias("__k")).distinct()
    checked = fresh.join(there, F.col(key) == F.col("__k"), "left")
    first = checked.columns[0]
    guard = F.when(F.col("__k").isNotNull(), F.raise_error(F.concat(F.lit("already there: "), F.col(key).cast("string"))).cast(fresh.schema[first].dataType)).otherwise(F.col(first))
    return kept.unionByName(checked.withColumn(first, guard).drop("__k"))


def improving(rows: DataFrame, key: str, turn: str, qualities: Sequence[str], least: int = 2) -> DataFrame:
    """(key, turn, best, stopped): the turn whose qualities each key keeps, going on as long as ``least`` of them improve.

    A turn is taken if at least ``least`` qualities are greater than those of the turn taken before and
    the first is not less; the first turn that is not taken ends the sequence. Only the order of turns matters.
    """
    at = Window.partitionBy(key).orderBy(turn)
    gains = sum(((F.col(q) > F.lag(q).over(at)).cast("int") for q in qualities), F.lit(0))
    fails = F.coalesce((gains < least) | (F.col(qualities[0]) < F.lag(qualities[0]).over(at)), F.lit(False))
    # All turns up to the first failure are taken, so each is compared with the one just before it.
    marked = rows.withColumn("__fail", fails).withColumn("__ended", F.max(F.col("__fail").cast("int")).over(at.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.groupBy(key).agg(F.max(F.when(F.col("__ended") == 0, F.col(turn))).alias("best"), F.count("*").alias("turns"), F.min(F.when(F.col("__ended") == 1, F.col(turn))).alias("stopped"))


def matches_manifest(manifest: DataFrame, found: DataFrame, key: str, size: str, digest: str) -> DataFrame:
    """(key, fault) of manifest rows: missing, size or hash; rows that agree don't come out."""
    there = found.select(F.col(key), F.col(size).alias("__s"), F.col(digest).alias("__d"), F.lit(True).alias("__t"))
    joined = manifest.join(there, key, "left")
    fault = F.when(F.col("__t").isNull(), "missing").when(~F.col(size).eqNullSafe(F.col("__s")), "size").when(~F.col(digest).eqNullSafe(F.col("__d")), "hash")
    return joined.select(key, fault.alias("fault")).where("fault IS NOT NULL")


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(rule, broken, first_key) for each rule; a rule holds where its condition is true or null. One pass, one row a rule."""
    broken = lambda c: F.coalesce(~c, F.lit(False))
    totals = rows.agg(*(F.count_if(broken(c)).alias(f"n{i}") for i, c in enumerate(rules.values())), *(F.min(F.when(broken(c), F.col(key))).alias(f"k{i}") for i, c in enumerate(rules.values())))
    pairs = F.array(*(F.struct(F.lit(r).alias("rule"), F.col(f"n{i}").alias("broken"), F.col(f"k{i}").alias("first_key")) for i, r in enumerate(rules)))
    return totals.select(F.inline(pairs))


def partial_reference(asked: DataFrame, store: DataFrame, part: str, name: str) -> DataFrame:
    """(part, name, matches): the one stored name that holds each part, null where none or several do.

    A part meets only names that hold its first three letters somewhere; shorter parts are refused (null, 0).
    No side is broadcast: by their files Spark takes the names, a row for each run of letters, for far smaller than they are.
    """
    runs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, 3)))
    own = asked.select(F.col(part)).where(F.length(part) >= 3).distinct().withColumn("__g", F.substring(part, 1, 3))
    names = store.select(F.col(name)).where(F.length(name) >= 3).distinct().withColumn("__g", F.explode(runs(F.col(name))))
    hits = own.join(names.hint("merge"), "__g").where(F.col(name).contains(F.col(part))).groupBy(part).agg(F.min(name).alias("__n"), F.count("*").alias("__c"))
    return asked.select(part).distinct().join(hits.hint("merge"), part, "left").select(part, F.when(F.col("__c") == 1, F.col("__n")).alias(name), F.coalesce("__c", F.lit(0)).alias("matches"))


def union_types(parts: Sequence[tuple[str, DataFrame, dict[str, Column]]], tag: str = "source_kind") -> DataFrame:
    """One table of several dialects: each part's columns by their expressions, missing ones null, with its tag."""
    names = list(dict.fromkeys(n for _, _, m in parts for n in m))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.select(F.lit(t).alias(tag), *(m[n].alias(n) for n in names if n in m)) for t, df, m in parts))
