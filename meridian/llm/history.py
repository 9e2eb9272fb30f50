"""New batches against all history: an inverted index of rare-token prefixes, kept between batches."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meridian.llm.places import abbreviated, area, core, fold, number, one_slip, same_area, slots
from meridian.runtime import BROADCAST_BYTES, get_text, put_text, scratch, written

#: Slots of the hashed trigrams; the table of their frequencies is a literal of this length.
SLOTS = 16384
#: One slip of the pen changes at most this many trigrams of a name.
SLIP_GRAMS = 4
#: A name of so few trigrams is posted under its spellings short of one letter too, up to this length.
SHORT_NAME = 64
#: Months of one folder of postings, and postings of one of its files.
SPAN_MONTHS, FILE_POSTINGS = 120, 500_000
#: A word is a kind of site, not part of a name, if at least this share of the different names, and so many, hold it.
KIND_SHARE, KIND_NAMES = 1 / 1000, 8

_FACTS = ["ym", "day", "num", "name", "area", "short", "cc"]


def signatures(rows: DataFrame) -> DataFrame:
    """One row for each assertion: id, batch, and what tells its event.

    Rows without id, batch, place or month can't be told apart and are left out. An id delivered
    again, in whatever batch, counts in its lowest batch.
    """
    place, region = fold(F.col("place")), F.col("region")
    base = rows.where("assertion_id IS NOT NULL AND batch_no IS NOT NULL").select(
        F.col("assertion_id").alias("id"), F.col("batch_no").cast("int").alias("batch"), F.substring("date_iso", 1, 4).try_cast("int").alias("y"),
        F.substring("date_iso", 6, 2).try_cast("int").alias("m"), F.substring("date_iso", 9, 2).try_cast("int").alias("day"), number(place).alias("num"), core(place).alias("name"),
        area(region).alias("area"), abbreviated(region).alias("short"), F.upper(F.coalesce("country_code", F.lit(""))).alias("cc"),
    )
    base = base.where("name <> '' AND y IS NOT NULL AND m IS NOT NULL").withColumn("ym", F.col("y") * 12 + F.col("m"))
    once = base.groupBy("id").agg(F.min(F.struct("batch", *_FACTS)).alias("r")).select("id", "r.*")
    return once.withColumn("sig", F.concat_ws("|", "ym", F.coalesce(F.col("day").cast("string"), F.lit("")), *_FACTS[2:]))


def _short_tokens(name: Column, grams: Column) -> Column:
    """Slots by which names of few trigrams meet, else none.

    Two names one slip apart share a spelling short of one letter, or the shorter is that spelling of
    the longer. Long names of few trigrams, which repeat themselves, meet by their length, or the next.
    """
    slot = lambda kind, c: F.pmod(F.xxhash64(F.lit(kind), c), F.lit(SLOTS)).cast("int")
    n = F.length(name)
    spelled = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(SHORT_NAME))), lambda i: slot("less", F.concat(F.substring(name, F.lit(1), i - 1), F.substring(name, i + 1, n))))
    lengths = F.array(slot("length", n), slot("length", n + 1))
    few = F.size(grams) <= SLIP_GRAMS
    return F.when(few & (n <= SHORT_NAME), F.array_distinct(F.concat(F.array(slot("less", name)), spelled))).when(few, lengths).otherwise(F.array().cast("array<int>"))


class HistoryIndex:
    """Postings of everything accepted, in a folder; a batch is probed, then accepted.

    An event is posted under the rarest ``SLIP_GRAMS + 1`` of its tokens (month, trigram). Two
    names that are one slip apart share all but ``SLIP_GRAMS`` of their trigrams, so by the prefix
    principle their prefixes share a token wherever one of them has more trigrams than that; names
    of fewer are posted under further tokens, which meet too. So candidates are complete. The
    order of rarity is that of the first batch and stays fixed.

    Equal events of a batch are one posting, that of the smallest id, so copies never meet in
    pairs. Postings lie in folders by batch and span of months, sorted by token; a probe reads the
    spans, and in them the row groups, of the months that the batch has, sifts them by the batch's
    tokens, and shuffles what remains. What else the index knows (order of rarity, words of the
    names, batches accepted) is beside the postings, so another session opens it by its path; a
    batch counts once its name is in that state, and one that was interrupted is written anew.
    """

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path or scratch(spark, "history")
        state = json.loads(get_text(spark, f"{self.path}/state.json") or "{}")
        self.batches: list[int] = state.get("batches", [])
        self.rarity: list[int] | None = state.get("rarity")

    def _keep(self) -> None:
        put_text(self.spark, f"{self.path}/state.json", json.dumps({"batches": self.batches, "rarity": self.rarity}))

    def _fit(self, sigs: DataFrame) -> None:
        """Trigram frequencies of the first batch; their number is bounded by the slots."""
        grams = sigs.select("name").distinct().select(F.explode(slots(F.col("name"), SLOTS)).alias("g")).groupBy("g").count()
        self.rarity = [0] * SLOTS
        for r in grams.collect():
            self.rarity[r["g"]] = r["count"]

    def _kinds(self, sigs: DataFrame, batch: int) -> list[str]:
        """Words that many different names hold, in this batch's names or those before; at most 1 / ``KIND_SHARE`` words a name."""
        names = sigs.select("name").distinct().where(F.col("name").contains(" "))
        words = names.select(F.explode(F.array_distinct(F.split("name", " "))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
        words = words.unionByName(names.agg(F.lit("").alias("word"), F.count("*").alias("n")))
        if self.batches:
            words = words.unionByName(self.spark.read.parquet(f"{self.path}/words/batch={self.batches[-1]}").select("word", "n")).groupBy("word").agg(F.sum("n").alias("n"))
        seen = Observation()
        words.observe(seen, F.max(F.when(F.col("word") == "", F.col("n"))).alias("names")).write.mode("overwrite").parquet(f"{self.path}/words/batch={batch}")
        words = self.spark.read.schema("word string, n long").parquet(f"{self.path}/words/batch={batch}")
        total = seen.get["names"] or 0
        return [r["word"] for r in words.where((F.col("word") != "") & (F.col("n") >= max(KIND_NAMES, total * KIND_SHARE))).collect()]

    def _post(self, sigs: DataFrame, batch: int, rows: int) -> tuple[DataFrame, list[int], int]:
        """Writes the postings of a batch of at most ``rows`` rows: read back, their months and their number."""
        events = sigs.groupBy("sig").agg(F.min("id").alias("id"), *(F.first(c).alias(c) for c in _FACTS))
        events = events.withColumn("grams", slots(F.col("name"), SLOTS)).withColumn("n", F.size("grams"))
        rarity = F.split(F.lit(",".join(map(str, self.rarity))), ",").cast("array<int>")
        ranked = F.array_sort(F.transform("grams", lambda g: F.struct(F.get(rarity, g).alias("f"), g.alias("g"))))
        prefix = F.array_distinct(F.concat(F.transform(F.slice(ranked, 1, SLIP_GRAMS + 1), lambda x: x["g"]), _short_tokens(F.col("name"), F.col("grams"))))
        tokens = F.transform(prefix, lambda g: F.col("ym").cast("bigint") * SLOTS + g)
        # Who asks is told by the signature; the first batch asks nothing.
        sig = F.unhex(F.md5("sig")) if self.batches else F.lit(None).cast("binary")
        posted = events.select(F.explode(tokens).alias("token"), "id", *_FACTS, "n", sig.alias("sig"), F.floor(F.col("ym") / SPAN_MONTHS).cast("int").alias("span"))
        files = max(1, math.ceil(rows * (SLIP_GRAMS + 1) / FILE_POSTINGS))
        spread = posted.repartition(max(files, self.spark.sparkContext.defaultParallelism), F.col("span"), F.pmod(F.xxhash64("token"), F.lit(files)))
        path = f"{self.path}/postings/batch={batch}"
        seen = Observation()
        spread = spread.observe(seen, F.collect_set("ym").alias("months"), F.count("*").alias("n"))
        spread.sortWithinPartitions("span", "token").write.mode("overwrite").option("compression", "zstd").partitionBy("span").parquet(path)
        return self.spark.read.schema(posted.schema).parquet(path), sorted(seen.get["months"] or []), seen.get["n"] or 0

    def _probe(self, posted: DataFrame, months: list[int], n: int, kinds: list[str]) -> DataFrame:
        """(sig, batch, earlier): for events that history tells, the posting of the lowest batch and id."""
        if not months:
            return posted.select("sig", F.lit(0).alias("batch"), F.col("id").alias("earlier")).limit(0)
        spans = sorted({m // SPAN_MONTHS for m in months})
        kept = [f for f in posted.schema.names if f not in ("sig", "span")]
        read = self.spark.read.schema(T.StructType([*posted.schema, T.StructField("batch", T.IntegerType())])).option("basePath", f"{self.path}/postings")
        history = read.parquet(*(f"{self.path}/postings/batch={b}" for b in self.batches))
        history = history.where(F.col("span").isin(spans) & F.col("ym").between(months[0], months[-1]) & F.col("ym").isin(months)).select("batch", *kept)
        # A long and its entry in the hashed relation are some 32 bytes; where the batch is larger, the join itself sifts.
        if n * 32 <= BROADCAST_BYTES:
            history = history.join(F.broadcast(posted.select("token").distinct()), "token", "left_semi")
        a, b = history.alias("a"), posted.alias("b")
        name, other = F.col("a.name"), F.col("b.name")
        days = F.col("a.day").isNull() | F.col("b.day").isNull() | (F.abs(F.col("a.day") - F.col("b.day")) <= 2)
        # From the cheapest test to the dearest: a slip is at most two letters' change, whatever its trigrams.
        pairs = a.join(b, "token").where((F.col("a.num") == F.col("b.num")) & days & (F.abs(F.length(name) - F.length(other)) <= 1) & (F.abs(F.col("a.n") - F.col("b.n")) <= SLIP_GRAMS))
        pairs = pairs.where((name == other) | (F.levenshtein(name, other, 2) >= 0))
        pairs = pairs.where(((F.col("a.area") != "") & (F.col("b.area") != "")) | (F.col("a.cc") == "") | (F.col("b.cc") == "") | (F.col("a.cc") == F.col("b.cc")))
        pairs = pairs.where(same_area(F.col("a.area"), F.col("a.short"), F.col("b.area"), F.col("b.short")))
        first = F.concat(F.lpad(F.col("a.batch").cast("string"), 10, "0"), F.lit("|"), "a.id")
        # A pair of names is verified once, however many tokens, copies and batches it met by: of those the first counts.
        # The asked name is its signature's; as an aggregate it keeps the verification from being moved below, into the join.
        once = pairs.groupBy("b.sig", name.alias("a")).agg(F.min(first).alias("first"), F.min(other).alias("b"))
        a, b, grams = F.col("a"), F.col("b"), lambda c: slots(c, SLOTS)
        same = F.size(F.array_intersect(grams(a), grams(b))) >= F.greatest(F.size(grams(a)), F.size(grams(b))) - SLIP_GRAMS
        words = lambda x, y: F.array_except(F.split(x, " "), F.split(y, " "))
        common = F.split(F.lit(" ".join(kinds)), " ")
        kept = ~(F.arrays_overlap(words(a, b), common) & F.arrays_overlap(words(b, a), common))
        told = once.where((a == b) | (one_slip(a, b) & same & kept)).groupBy("sig").agg(F.min("first").alias("first"))
        return told.select("sig", F.substring("first", 1, 10).cast("int").alias("batch"), F.substring("first", 12, 1 << 30).alias("earlier"))

    def accept(self, sigs: DataFrame, batch: int, rows: int | None = None) -> DataFrame | None:
        """(sig, batch, earlier) for the batch's events that history tells, ``sig`` hashed; then the batch is history too.

        ``sigs`` has the batch's ``signatures``; ``rows`` is their number where it is known. Batches
        come in rising order; one accepted before is refused. None where there is no history yet.
        """
        if self.batches and batch <= self.batches[-1]:
            raise ValueError(f"batch {batch} comes after batch {self.batches[-1]} was accepted")
        if self.rarity is None:
            self._fit(sigs)
        posted, months, n = self._post(sigs, batch, sigs.count() if rows is None else rows)
        kinds = self._kinds(sigs, batch)
        found = written(self._probe(posted, months, n, kinds), "found") if self.batches else None
        self.batches.append(batch)
        self._keep()
        return found


def retold(rows: DataFrame, path: str | None = None) -> DataFrame:
    """(id, earlier, earlier_batch): each row of a later batch whose event a lower batch tells.

    ``earlier`` is the row of the lowest batch telling it, of several the smallest id. Batches go
    in order, each probed against the index of those below, then accepted. With the ``path`` of an
    index that was kept, batches that it has are history, and only the others are probed.
    """
    spark = rows.sparkSession
    sigs = written(signatures(rows), "signatures", "batch")
    sizes = {r["batch"]: r["count"] for r in sigs.groupBy("batch").count().collect()}
    index, found = HistoryIndex(spark, path), []
    for batch in sorted(b for b in sizes if b not in index.batches):
        told = index.accept(sigs.where(F.col("batch") == batch), batch, sizes[batch])
        if told is not None:
            found.append(told.select("sig", F.col("batch").alias("earlier_batch"), "earlier", F.lit(batch).alias("batch")))
    if not found:
        return sigs.select("id", F.col("id").alias("earlier"), F.col("batch").alias("earlier_batch")).limit(0)
    every = found[0]
    for told in found[1:]:
        every = every.unionByName(told)
    own = sigs.select("id", "batch", F.unhex(F.md5("sig")).alias("sig"))
    return own.join(every, ["batch", "sig"]).select("id", "earlier", "earlier_batch")
