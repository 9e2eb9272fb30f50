"""Filling containers of fixed capacity: best-fit decreasing, certified by lower bounds."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.tokens import sizes
from meridian.runtime import written

#: Items that one partition packs; memory of a task is bounded by it.
PARTITION_ITEMS = 40_000


def lower_bound(n: np.ndarray, capacity: int) -> int:
    """Least number of containers by dual feasible functions; items are from 0 to ``capacity``.

    The greatest of the sum bound, the bounds that round large items up for each threshold, and
    the bounds that round each size to multiples of 1/k, k up to 16.
    """
    if not len(n):
        return 0
    n = n.astype(np.int64)
    count = np.bincount(n, minlength=capacity + 1)
    weight = count * np.arange(capacity + 1)
    below_n, below_w = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(weight)])
    k = np.arange(1, capacity // 2 + 1)
    mid = capacity // 2
    large = below_n[-1] - below_n[capacity - k + 1]
    middle_n, middle_w = below_n[capacity - k + 1] - below_n[mid + 1], below_w[capacity - k + 1] - below_w[mid + 1]
    small_w = below_w[mid + 1] - below_w[k]
    spare = np.maximum(0, small_w - (middle_n * capacity - middle_w))
    best = max(math.ceil(n.sum() / capacity), int((large + middle_n + -(-spare // capacity)).max(initial=0)))
    for k in range(1, 17):
        whole = (k + 1) * n % capacity == 0
        value = np.where(whole, n * k, (k + 1) * n // capacity * capacity)
        best = max(best, -(-int(value.sum()) // (k * capacity)))
    return max(best, 1)


def best_fit(n: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item: largest first, each to the fullest container that takes it."""
    out = np.zeros(len(n), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    free, opened = 0, 0  # bit r of free: a container with r units left is open
    for i in np.argsort(-n, kind="stable"):
        size = int(n[i])
        fitting = free >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            box = stacks[left].pop()
            if not stacks[left]:
                free ^= 1 << left
        else:
            box, left, opened = opened, capacity, opened + 1
        left -= size
        if not stacks[left]:
            free |= 1 << left
        stacks[left].append(box)
        out[i] = box
    return out


def pack(items: DataFrame, key: str, size: str, capacity: int, partition_items: int = PARTITION_ITEMS) -> DataFrame:
    """Every item's container: key, piece, start, size, container_id, container_items, container_size, certified.

    An item is cut only if it alone exceeds ``capacity``: into pieces of just the capacity, each a
    full container, and a rest that is packed like any item; ``start`` is the piece's offset.
    Items of size 0 or null lie in a container without filling it. Repeated rows are items of
    their own, null keys too. An empty table gives no rows; other columns are ignored.

    Items are spread by hash into partitions of a bounded number of items, so equal sizes or keys
    never gather. Each partition packs best-fit decreasing and certifies its number of containers
    by ``lower_bound``. Partitions above their bound exchange their items under another hash (a
    single one with a certified one) and are packed again, as long as their gaps shrink. The
    containers of partitions that reach their bound, and full ones, are ``certified``: no packing
    of the partition's items takes fewer.
    """
    kind = items.schema[key].dataType.simpleString()
    n = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0))
    cuts = F.when(n > capacity, F.ceil(n / capacity).cast("long")).otherwise(F.lit(1))
    pieces = items.select(F.col(key).alias("k"), n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), cuts - 1)).alias("piece"))
    pieces = pieces.select("k", "piece", (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("int").alias("size"))
    pieces = written(pieces.withColumn("seed", F.monotonically_increasing_id()), "pieces")
    full = pieces.where(F.col("size") == capacity)
    shape = f"k {kind}, piece long, start long, size int, seed long, box long, part long, boxes long, bound long"
    done = full.select("k", "piece", "start", "size", "seed", F.concat(F.lit("f"), F.format_string("%x", F.xxhash64("seed")), F.lit("-"), F.col("seed")).alias("container_id"), F.lit(True).alias("certified"))
    columns = ["k", "piece", "start", "size", "seed", "container_id", "certified"]
    rest, gap_before, kept_open = pieces.where(F.col("size") < capacity), math.inf, None

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf["size"].to_numpy()
        box = best_fit(n, capacity)
        return pdf.assign(box=box, boxes=int(box.max()) + 1, bound=lower_bound(n, capacity))

    for turn in itertools.count():
        total = rest.count()
        if not total:
            break
        parts = math.ceil(total / partition_items)
        placed = rest.withColumn("part", F.pmod(F.xxhash64("seed", F.lit(turn)), F.lit(parts)))
        placed = written(placed.groupBy("part").applyInPandas(fill, shape), "packed")
        gaps = placed.groupBy("part").agg(F.first(F.col("boxes") - F.col("bound")).alias("gap"))
        gap, open_, certain = gaps.agg(F.coalesce(F.sum("gap"), F.lit(0)), F.count_if(F.col("gap") > 0), F.min(F.when(F.col("gap") == 0, F.col("part")))).first()
        if gap > gap_before:  # the packing before was better
            done = done.unionByName(kept_open)
            break
        named = placed.withColumns({"container_id": F.format_string("r%d-%d-%d", F.lit(turn), "part", "box"), "certified": F.col("boxes") == F.col("bound")})
        if gap in (0, gap_before) or parts == 1:
            done = done.unionByName(named.select(columns))
            break
        again = F.col("boxes") > F.col("bound")
        if open_ == 1 and certain is not None:
            again |= F.col("part") == certain
        done = done.unionByName(named.where(~again).select(columns))
        gap_before, kept_open, rest = gap, named.where(again).select(columns), placed.where(again).select("k", "piece", "start", "size", "seed")
    load = done.groupBy("container_id").agg(F.count("*").alias("container_items"), F.sum("size").alias("container_size"))
    return done.join(load, "container_id").select(F.col("k").alias(key), "piece", "start", "size", "container_id", "container_items", "container_size", "certified")


def pack_documents(docs: DataFrame, key: str, text: str, capacity: int) -> DataFrame:
    """``pack`` of texts by their tokens of the 50k byte-level vocabulary."""
    return pack(sizes(docs, key, text), key, "tokens", capacity)
