"""Token counts of a public tokenizer inside Python workers."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public vocabularies; never copied into the repository.
TOKENIZERS = os.environ.get("MERIDIAN_TOKENIZERS", "/opt/tokenizers")
RANKS = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"

# Fixed value: the pattern that cuts a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load(path: str = RANKS):
    """The tokenizer of a file of ranks, loaded once in a worker; it knows no special tokens."""
    import tiktoken

    kept = tiktoken.__dict__.setdefault("_meridian", {})  # outlives the functions that Spark sends
    if path not in kept:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        kept[path] = tiktoken.Encoding(os.path.basename(path), pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
    return kept[path]


def sizes(rows: DataFrame, key: str, text: str, path: str = RANKS) -> DataFrame:
    """(key, tokens) of every row; a null or empty text has no tokens."""
    kind = rows.schema[key].dataType.simpleString()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load(path).encode_to_numpy
        for pdf in batches:
            yield pd.DataFrame({"k": pdf["k"], "tokens": [len(encode(t)) if t else 0 for t in pdf["t"]]})

    return rows.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(count, f"k {kind}, tokens int").withColumnRenamed("k", key)
