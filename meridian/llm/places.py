"""Comparable forms of place and region names, as column expressions inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that look like Latin ones, pairwise in both strings; letters without a decomposition.
LOOK_ALIKE = "АВЕЅІЈКМНОРСТХУԚԜҮаеѕіјорсухһԁԛԝӏգցոսհүгΑΒΕΖΗΙΚΜΝΟΡΤΥΧαοινρυκτ"
LOOKS_LIKE = "ABESIJKMHOPCTXYQWYaesijopcyxhdqwlgqnuhyrABEZHIKMNOPTYXaoivpukt"
_PLAIN = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl"}
_SINGLE = {"ł": "l", "ø": "o", "đ": "d", "ð": "d", "ı": "i", "ħ": "h", "ŧ": "t", "ĸ": "k", "ŋ": "n", "ſ": "s"}


def _accents() -> tuple[str, str]:
    """Lower-case Latin letters with marks, and their bases, by canonical decomposition."""
    old, new = "".join(_SINGLE), "".join(_SINGLE.values())
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        c = chr(code)
        base = unicodedata.normalize("NFD", c)[0]
        if c.islower() and base != c and base.isascii():
            old, new = old + c, new + base
    return old, new


# Words that say where to from a place, before its name, maybe after what lies there.
_ADDED = r"^(?:(?:the )?(?:fields?|crops?|land|site|area) )?(?:nr|near|nearby|at|by|beside|outside|opposite|behind|above|below|(?:close|next|adjacent) to|just off|(?:just )?(?:north|south|east|west|ne|nw|se|sw) of) (?=\S)"

_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(map(chr, range(0x21, 0x7F)))


def fold(text: Column) -> Column:
    """Lower case without marks, invisible signs, width variants and look-alikes; null stays null."""
    c = F.regexp_replace(text, r"[\p{M}\p{Cf}]", "")
    c = F.lower(F.translate(F.translate(c, _WIDE, _NARROW), LOOK_ALIKE, LOOKS_LIKE))
    c = F.translate(c, *_accents())
    for sign, plain in _PLAIN.items():
        c = F.replace(c, F.lit(sign), F.lit(plain))
    return F.when(text.rlike(r"^[\x00-\x7f]*$"), F.lower(text)).otherwise(c)


def number(folded: Column) -> Column:
    """The bracketed number of a folded place name, or the empty string."""
    return F.regexp_extract(folded, r"\(\s*(\d+)\s*\)", 1)


def core(folded: Column) -> Column:
    """A folded place name without brackets, added directions and spelled-out umlauts."""
    c = F.regexp_replace(folded, r"\([^)]*\)|\[[^\]]*\]", " ")
    c = F.regexp_replace(c, r"[,;/].*$", "")
    c = F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "))
    c = F.regexp_replace(c, _ADDED, "")
    return F.regexp_replace(c, r"([aou])e|a(a)", "$1$2")


def area(text: Column) -> Column:
    """A region name folded to letters and digits, the empty string where it is missing."""
    return F.coalesce(F.regexp_replace(fold(text), r"[^\p{L}\p{N}]+", ""), F.lit(""))


def abbreviated(text: Column) -> Column:
    return F.coalesce(F.trim(text).endswith("."), F.lit(False))


def same_area(a: Column, a_short: Column, b: Column, b_short: Column) -> Column:
    """Whether two areas can be the same: one missing, one letter off, or one the other's abbreviation."""
    return (a == "") | (b == "") | (a == b) | (a_short & b.startswith(a)) | (b_short & a.startswith(b)) | (F.levenshtein(a, b, 1) >= 0)


def one_slip(a: Column, b: Column) -> Column:
    """Whether names differ by at most one letter added, lost or changed, or two neighbours swapped."""
    letters = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    changed = F.filter(F.transform(letters, lambda p, i: F.struct(i.alias("i"), p["x"].alias("x"), p["y"].alias("y"))), lambda p: p["x"] != p["y"])
    first, second = F.get(changed, F.lit(0)), F.get(changed, F.lit(1))
    swapped = (F.size(changed) == 2) & (second["i"] == first["i"] + 1) & (first["x"] == second["y"]) & (first["y"] == second["x"])
    return (a == b) | (F.levenshtein(a, b, 1) >= 0) | ((F.length(a) == F.length(b)) & (F.levenshtein(a, b, 2) == 2) & F.coalesce(swapped, F.lit(False)))


def slots(name: Column, size: int) -> Column:
    """Distinct hashed trigrams of a name, as slots of a table of ``size``."""
    padded = F.concat(F.lit("^"), name, F.lit("$"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - 2, F.lit(1))), lambda i: F.pmod(F.xxhash64(F.substring(padded, i, 3)), F.lit(size)).cast("int"))
    return F.array_distinct(grams)
