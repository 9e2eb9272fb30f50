"""Byte-level BPE inside Spark: ranked merges folded over the bytes of distinct words.

A vocabulary's merges become a literal: a two-way hash table of (left id, right id) -> merged id
laid out in arrays, looked up in two probes. Each distinct word of the corpus is encoded once by
``aggregate`` over its bytes; a step merges every occurrence of its lowest-ranked pair. The ids
of the commonest words also become a bounded literal, so that most of a text is encoded where it
lies, and only its rarer words are shuffled to the dictionary of words. Texts are cut into words,
and words numbered, in Python.
"""

from __future__ import annotations

import json
import math
import os
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.runtime import written

#: Folder of the public vocabularies; never copied into the repository.
TOKENIZERS = os.environ.get("MERIDIAN_TOKENIZERS", "/opt/tokenizers")
#: Commonest words kept as a literal, and the texts they come from.
HOT_WORDS, SAMPLE_TEXTS = 20000, 5000
#: Texts that a task codes at a time.
CODED_AT_ONCE = 1000
#: Texts whose rarer words one task folds.
TASK_TEXTS = 5000

# The pattern that cuts a text into words, with white space as Unicode has it. Letters and
# digits come first: nothing else can match where they do, and most words are theirs.
_SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
PATTERN = rf" ?(?:\p{{L}}++|\p{{N}}++)|'(?:s|t|re|ve|m|ll|d)| ?[^{_SPACE}\p{{L}}\p{{N}}]++|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def _class(major: str) -> str:
    """The characters below 0x10000 of a general category, as ranges of a character class."""
    of = "".join("x" if unicodedata.category(chr(c))[0] == major else " " for c in range(0x10000))
    return "".join(f"{re.escape(chr(m.start()))}-{re.escape(chr(m.end() - 1))}" for m in re.finditer("x+", of))


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def vocabulary(path: str) -> tuple[list[int], dict[int, int], list[bytes]]:
    """(id of each byte, {left << 16 | right: merged id}, bytes of each id) of a byte-level BPE file."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    ids, letters = model["vocab"], _byte_letters()
    spelled = lambda token: bytes(letters[c] for c in token)
    merges = {}
    for pair in model["merges"]:
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        merges[ids[left] << 16 | ids[right]] = ids[left + right]
    pieces = [b""] * (max(ids.values()) + 1)
    for token, i in ids.items():
        if all(c in letters for c in token):
            pieces[i] = spelled(token)
    single = [0] * 256
    for c, b in letters.items():
        single[b] = ids[c]
    return single, merges, pieces


def _slots(keys: list[int]) -> tuple[int, int, list[int], list[int]]:
    """A two-way table: (sizes of both halves, keys of both halves), -1 where empty."""
    for size in range(len(keys) | 1, 8 * len(keys) + 99, 2 * (len(keys) // 16) + 2):
        other = size + 2
        first, second = [-1] * size, [-1] * other
        for key in keys:
            for turn in range(200):
                table, at = (first, key % size) if turn % 2 == 0 else (second, (key // size + key * 7) % other)
                key, table[at] = table[at], key
                if key == -1:
                    break
            if key != -1:
                break
        else:
            return size, other, first, second
    raise ValueError("no table found")


def _literal(values: list[int], kind: str) -> Column:
    """A constant array; the optimizer folds it to one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def encode_word(word: Column, path: str) -> Column:
    """Ids of a non-empty word, as array<int>."""
    single, merges, _ = vocabulary(path)
    size, other, first, second = _slots(sorted(merges))
    merged_ids = [merges.get(k, -1) for k in first + second]
    none = F.lit(1 << 30)
    letters = F.filter(F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), ""), lambda c: c != "")

    def fold(keys: Column, merged: Column) -> Column:
        def rank(key: Column) -> Column:
            a, b = (key % size).cast("int"), (F.lit(size) + (F.floor(key / size).cast("bigint") + key * 7) % other).cast("int")
            return F.when(F.get(keys, a) == key, F.get(merged, a)).when(F.get(keys, b) == key, F.get(merged, b)).otherwise(none)

        def ranks(parts: Column) -> Column:
            pair = F.zip_with(F.slice(parts, F.lit(1), F.size(parts) - 1), F.slice(parts, F.lit(2), F.size(parts) - 1), lambda a, b: a.cast("bigint") * 65536 + b)
            return F.transform(pair, rank)

        def state(parts: Column) -> Column:
            return _let(parts, lambda p: _let(ranks(p), lambda r: F.struct(p.alias("p"), r.alias("r"), F.coalesce(F.array_min(r), none).alias("m"))))

        def step(s: Column) -> Column:
            p, r, m = s["p"], s["r"], s["m"]
            # A pair of two equal parts may overlap itself: of those only the first is merged at a time.
            here = lambda i, at: (F.get(r, i) == m) & ((i == at) | (F.get(p, i) != F.get(p, i + 1)))
            swap = lambda at: F.filter(F.transform(p, lambda x, i: F.when((i > 0) & here(i - 1, at), F.lit(None)).when(here(i, at), m).otherwise(x)), lambda x: x.isNotNull())
            return state(_let((F.array_position(r, m) - 1).cast("int"), swap))

        bytes_ids = F.transform(letters, lambda c: F.get(_literal(single, "int"), F.ascii(c)))
        turns = F.sequence(F.lit(1), F.octet_length(word))
        return F.aggregate(turns, state(bytes_ids), lambda s, _: F.when(s["m"] >= none, s).otherwise(step(s)), lambda s: s["p"])

    # Bound to variables, the tables are in the plan once each.
    return _let(_literal(first + second, "bigint"), lambda keys: _let(_literal(merged_ids, "int"), lambda merged: fold(keys, merged)))


def words_of(text: Column) -> Column:
    """The words of a text in order; together they are the text."""
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def cutter() -> Callable[[str], list[str]]:
    """``words_of`` in Python, where words are looked up one by one in far less time than higher-order functions take."""
    import regex

    pattern = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: chr(int(m[1], 16)), PATTERN)
    whole, wide = regex.compile(pattern).findall, re.compile("[\U00010000-\U0010ffff]").search
    # The standard module is faster; it needs the classes spelled out, and only those below 0x10000 are quick.
    of = {major: _class(major) for major in "LN"}
    pattern = pattern.replace(r"\p{L}\p{N}]", f"{of['L']}{of['N']}]").replace(r"\p{L}", f"[{of['L']}]").replace(r"\p{N}", f"[{of['N']}]")
    quick = re.compile(pattern).findall
    return lambda text: whole(text) if wide(text) else quick(text)


def encode(rows: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, ids) of every row, ids a list of integers without special tokens.

    Null and empty texts have the empty list. A special token's spelling in a text is ordinary
    text. Rows are neither dropped nor merged: a null or repeated key comes out as often as it
    went in. Other columns are ignored. A text of any length is one row of its words; a word of
    any length is one row of its bytes.

    The ids of the commonest words of a bounded sample are a literal of ``HOT_WORDS`` entries at most;
    they are filled in where the text lies. A text's other words are numbered within it, made
    distinct over the corpus, folded once each, and joined back by word and text. Which words
    the literal has changes only the way, not the result.
    """
    path = path or f"{TOKENIZERS}/byte_bpe_50k.json"
    docs = rows.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("rid", F.monotonically_increasing_id())
    n = rows.count()
    # Texts from all over the table; a third more than wanted, since a sample's size varies.
    some = rows.select(F.col(text).alias("t")).sample(min(1.0, 4 / 3 * SAMPLE_TEXTS / max(1, n)), seed=7)
    hot = _hot(some.where("t <> ''").limit(SAMPLE_TEXTS), path)
    numbers = {w: i for i, w in enumerate(hot)}
    # A list of lists, which the optimizer folds to one literal: a common word's ids are taken as they are.
    common = F.from_json(F.lit(json.dumps(list(hot.values()) or [[0]], separators=(",", ":"))), "array<array<int>>")
    ids = lambda rare: _let(common, lambda table: F.flatten(F.transform("codes", lambda c: F.when(c < 0, F.get("rare", -c - 1)["ids"]).otherwise(F.get(table, c)) if rare else F.get(table, c))))

    def coded_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, number = cutter(), numbers.get
        for batch in (whole.slice(at, CODED_AT_ONCE) for whole in batches for at in range(0, whole.num_rows, CODED_AT_ONCE)):
            small, large, miss = [], [], []
            for t in batch.column("t").to_pylist():
                own: dict[str, int] = {}
                codes = [c if (c := number(w)) is not None else -own.setdefault(w, len(own) + 1) for w in cut(t)]
                # Two bytes a code, but for a text of very many words of its own.
                short = len(own) < 32768
                small.append(np.array(codes, np.int16) if short else None)
                large.append(None if short else np.array(codes, np.int32))
                miss.append(list(own))
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("rid"), pa.array(small, pa.list_(pa.int16())), pa.array(large, pa.list_(pa.int32())), pa.array(miss, pa.list_(pa.string()))], ["k", "rid", "small", "large", "miss"])

    # A word's code: its number among the common words, or minus its number, from 1, among the text's other words.
    kind = docs.schema["k"].dataType.simpleString()
    coded = written(docs.mapInArrow(coded_, f"k {kind}, rid long, small array<smallint>, large array<int>, miss array<string>"), "coded")
    codes = F.coalesce(F.col("small").cast("array<int>"), F.col("large")).alias("codes")
    misses = coded.select("rid", F.posexplode("miss").alias("i", "w"))
    # Spread by word, so that the fold is not left to a few merged partitions; more of them for more texts.
    spread = max(4 * docs.sparkSession.sparkContext.defaultParallelism, math.ceil(n / TASK_TEXTS))
    dictionary = written(misses.select("w").distinct().repartition(spread, "w").withColumn("ids", encode_word(F.col("w"), path)), "dictionary")
    rare = misses.join(dictionary, "w").groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("i", "ids"))).alias("rare"))
    joined = coded.where(F.size("miss") > 0).select("k", "rid", "small", "large").join(rare, "rid").select("k", codes, "rare")
    open_ = joined.select(F.col("k").alias(key), ids(True).alias("ids"))
    shut = coded.where(F.size("miss") == 0).select("k", codes).select(F.col("k").alias(key), ids(False).alias("ids"))
    return open_.unionByName(shut)


def _hot(texts: DataFrame, path: str) -> dict[str, list[int]]:
    """The sample's commonest words, of at most three tokens, with their ids."""
    counts = texts.select(F.explode(words_of(F.col("t"))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).where(F.length("w") < 40)
    top = counts.orderBy(F.desc("n"), "w").limit(HOT_WORDS).repartition(texts.sparkSession.sparkContext.defaultParallelism)
    found = top.select("w", "n", encode_word(F.col("w"), path).alias("ids")).collect()
    return {r["w"]: list(r["ids"]) for r in sorted(found, key=lambda r: (-r["n"], r["w"])) if len(r["ids"]) <= 3}


def decode(ids: Column, path: str | None = None) -> Column:
    """The text of a list of ids: its pieces' bytes together; null stays null."""
    _, _, pieces = vocabulary(path or f"{TOKENIZERS}/byte_bpe_50k.json")
    table = F.split(F.lit(",".join(p.hex() for p in pieces)), ",", -1)
    return F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), "")), "UTF-8")
