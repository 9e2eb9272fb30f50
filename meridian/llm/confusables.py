"""Text that looks alike made alike: invisible signs, width variants, split accents, look-alike letters."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.places import LOOK_ALIKE, LOOKS_LIKE
from meridian.runtime import written

# Look-alikes between scripts beyond those of ``places``; Latin letters of phonetic alphabets.
_MORE = {"ɡ": "g", "ɑ": "a", "Ѵ": "V", "ѵ": "v", "ʟ": "L", "Ԍ": "G", "ᴏ": "o", "σ": "o", "η": "n", "Ь": "b", "к": "k", "т": "t", "м": "m", "в": "b", "н": "h", "ӏ": "l", "Ӏ": "I", "ν": "v", "γ": "y", "ѡ": "w", "ω": "w", "β": "ß", "ϲ": "c", "Ϲ": "C", "ϳ": "j", "ⅼ": "l", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m", "ⅰ": "i", "ⅴ": "v", "ⅹ": "x", "Ⅰ": "I", "Ⅴ": "V", "Ⅹ": "X", "Ⅼ": "L", "Ⅽ": "C", "Ⅾ": "D", "Ⅿ": "M", "ё": "ë", "ї": "ï", "Ё": "Ë", "Ї": "Ï", "ά": "ά", "ό": "ó", "ί": "í"}
TO_LATIN = dict(zip(LOOK_ALIKE, LOOKS_LIKE)) | {"υ": "u", "κ": "k", "τ": "t", "х": "x", "г": "r"} | {k: v for k, v in _MORE.items() if k != v}
# Signs that can't be told from the ordinary one.
SIGNS = {"‐": "-", "‑": "-", "⁃": "-", "꞉": ":", "∶": ":", "ꓸ": ".", "‚": ",", "ǃ": "!", "∕": "/", "⁄": "/", "⧸": "/", "ʼ": "'", "＇": "'", ";": ";", "·": "·"}
SIGNS = {k: v for k, v in SIGNS.items() if k not in "‚⁄ʼ" and k != v}
_BLANK = re.compile("[   -   　]")
_UNSEEN = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ\U000e0000-\U000e01ef]")
_TOKEN = re.compile(r"[^\W\d_]+(?:[^\W\d_]|[̀-ͯ])*")
_SEGMENT = re.compile(r"(\s\|\s)")


def plain_forms(text: str) -> str:
    """``text`` with composed accents, ordinary blanks and widths, and without unseen signs.

    Quotes, dashes, dots, fractions, raised signs and № stay, as do the marks of other scripts.
    """
    text = _UNSEEN.sub("", _BLANK.sub(" ", text))
    out = []
    for c in text:
        kind = unicodedata.decomposition(c).partition(">")[0].lstrip("<") if ord(c) > 127 else ""
        folded = unicodedata.normalize("NFKC", c) if kind in ("wide", "narrow", "font") or (kind == "compat" and 0xFB00 <= ord(c) <= 0xFB4F) else c
        out.append(SIGNS.get(folded, folded))
    return unicodedata.normalize("NFC", "".join(out))


def script(char: str) -> str:
    """Script of a letter, the three of Japanese as one."""
    name = unicodedata.name(char, "").split(" ")[0]
    if char in "ɡɑʟᴏ":
        return "PHONETIC"
    if 0x2160 <= ord(char) <= 0x217F:
        return "NUMERAL"
    return "JAPANESE" if name in ("CJK", "HIRAGANA", "KATAKANA", "IDEOGRAPHIC", "KATAKANA-HIRAGANA") else name


_FROM_LATIN: dict[str, dict[str, str]] = {}
for _k, _v in TO_LATIN.items():
    _FROM_LATIN.setdefault(script(_k), {}).setdefault(_v, _k)


def swapped(token: str, to: str) -> str | None:
    """``token`` with all letters of other scripts replaced by their look-alikes of script ``to``; None if one has none."""
    out = []
    for c in token:
        own = script(c)
        if own == to or not c.isalpha():
            out.append(c)
        elif to == "LATIN" and c in TO_LATIN:
            out.append(TO_LATIN[c])
        elif own == "LATIN" and c in _FROM_LATIN.get(to, {}):
            out.append(_FROM_LATIN[to][c])
        elif TO_LATIN.get(c) in _FROM_LATIN.get(to, {}):
            out.append(_FROM_LATIN[to][TO_LATIN[c]])
        else:
            return None
    return "".join(out)


def suspects(text: str) -> list[tuple[str, str, bool]]:
    """(token, replacement, mixed) of tokens that may hold look-alikes.

    A mixed token goes to each script that the rest can be written in, its dominant one first, of
    equally frequent ones that of the text. A token wholly of another script than its text is a
    suspect too, if every letter has a look-alike.
    """
    out = []
    for part in _SEGMENT.split(text):
        tokens = _TOKEN.findall(part)
        of = Counter(s for t in tokens for s in map(script, t) if s not in ("PHONETIC", "NUMERAL", "COMBINING", ""))
        if not of:
            continue
        for token in tokens:
            own = Counter(s for s in map(script, token) if s not in ("COMBINING", ""))
            mixed = len(own) > 1 and not {"JAPANESE"} & set(own)
            foreign = len(own) == 1 and next(iter(own)) != max(of, key=lambda s: (of[s], s)) and "JAPANESE" not in own
            if not mixed and not foreign:
                continue
            scripts = sorted((s for s in of if s != "JAPANESE"), key=lambda s: (-own[s], -of[s], s)) if mixed else [max(of, key=lambda s: (of[s], s))]
            for to in scripts:
                other = swapped(token, to)
                if other and other != token:
                    out.append((token, other, mixed))
    return list(dict.fromkeys(out))


def unify(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, text, and unified of every row whose text holds what looks like something else.

    First invisible signs, blanks, widths and split accents are made ordinary. Then letters of
    another script than their token's are replaced by look-alikes where the result is a word of
    the corpus: the vocabulary holds the words in one script of all rows, after the first step and
    in lower case. A mixed token whose result is no word of the corpus is reported and left as it
    is. Null, empty and ASCII texts hold nothing of the kind; an empty table gives no rows;
    repeated rows count once. Words are counted before their shuffle; only suspected tokens meet
    the vocabulary. Tokens wholly in another script than their text, which mixed tokens are not,
    are replaced too where the result is a word of the corpus.
    """
    texts = rows.where(F.length(text) > 0).select(F.col(text).alias("t")).distinct()

    def normal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            flat = [plain_forms(t) for t in pdf["t"]]
            found = [suspects(t) if not t.isascii() else [] for t in flat]
            yield pd.DataFrame({"t": pdf["t"], "flat": flat, "suspects": [[{"token": a, "other": b, "mixed": m} for a, b, m in s] for s in found]})

    kind = "array<struct<token:string,other:string,mixed:boolean>>"
    # Read once by Python, then met again from the table: for its cases, its suspects and its words.
    odd = written(texts.where(F.col("t").rlike(r"[^\x00-\x7f]")).mapInPandas(normal, f"t string, flat string, suspects {kind}"), "odd")
    ascii_ = texts.where(~F.col("t").rlike(r"[^\x00-\x7f]")).select(F.col("t").alias("flat"), F.array().cast(kind).alias("suspects"))
    words = F.array_distinct(F.regexp_extract_all(F.lower("flat"), F.lit(r"[\p{L}\p{M}]+"), F.lit(0)))
    clean = odd.select("flat", "suspects").unionByName(ascii_)
    vocabulary = clean.select(F.explode(F.array_except(words, F.transform("suspects", lambda s: F.lower(s["token"])))).alias("word")).distinct()
    asked = odd.select("t", F.posexplode("suspects").alias("rank", "s")).select("t", "rank", "s.*").withColumn("word", F.lower("other"))
    known = asked.join(vocabulary, "word").groupBy("t", "token").agg(F.min_by("other", "rank").alias("other"), F.first("mixed").alias("mixed"))
    fixes = known.groupBy("t").agg(F.array_sort(F.collect_list(F.struct((-F.length("token")).alias("order"), "token", "other"))).alias("fixes"))
    joined = odd.join(fixes, "t", "left")
    fixed = F.aggregate(F.coalesce("fixes", F.array().cast("array<struct<order:int,token:string,other:string>>")), F.col("flat"), lambda text, f: F.replace(text, f["token"], f["other"]))
    mixed = F.exists("suspects", lambda s: s["mixed"])
    unified = joined.withColumn("unified", fixed).where((F.col("unified") != F.col("t")) | mixed).select("t", "unified")
    own = rows.select(*(F.col(k).alias(f"__{i}") for i, k in enumerate(keys)), F.col(text).alias("t"))
    return own.join(unified, "t").select(*(F.col(f"__{i}").alias(k) for i, k in enumerate(keys)), F.col("t").alias(text), "unified").distinct()
