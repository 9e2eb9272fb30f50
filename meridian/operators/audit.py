"""Audits as queries: what breaks a rule comes out as rows, with counts that are never empty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Rows whose non-null key is in no parent row."""
    return child.where(F.col(fk).isNotNull()).join(parent.select(F.col(pk).alias(fk)).distinct(), fk, "left_anti")


def foreign_keys(checks: dict[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """(rule, checked, missing, orphans): of each rule its rows, those without key and those without parent."""

    def one(name: str, child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
        known = parent.select(F.col(pk).alias(fk)).distinct().withColumn("__there", F.lit(True))
        joined = child.select(fk).join(known, fk, "left")
        return joined.agg(F.lit(name).alias("rule"), F.count("*").alias("checked"), F.count_if(F.col(fk).isNull()).alias("missing"), F.count_if(F.col(fk).isNotNull() & F.col("__there").isNull()).alias("orphans"))

    return reduce(DataFrame.unionByName, (one(n, *c) for n, c in checks.items()))


def uniqueness(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(rule, rows, keys, repeated): rows, different keys, and keys that occur again."""

    def one(name: str, df: DataFrame, key: str) -> DataFrame:
        per = df.groupBy(key).agg(F.count("*").alias("n"))
        return per.agg(F.lit(name).alias("rule"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("keys"), F.count_if(F.col("n") > 1).alias("repeated"))

    return reduce(DataFrame.unionByName, (one(n, *t) for n, t in tables.items()))


def certified(rows: DataFrame, key: str, expected_rows: int, columns: list[str]) -> DataFrame:
    """``rows``, or an error: the certificate names the count, the columns, and that keys are unique and present."""
    lacking = [c for c in columns if c not in rows.columns]
    if lacking:
        raise ValueError(f"columns missing: {', '.join(lacking)}")
    seen = rows.agg(F.count("*").alias("n"), F.count_distinct(key).alias("d")).first()
    if seen["n"] != expected_rows or seen["d"] != expected_rows:
        raise ValueError(f"{seen['n']} rows with {seen['d']} keys where {expected_rows} are certified")
    return rows
