"""Text, link and identifier functions as column expressions; each normaliser is its own, on purpose."""

from __future__ import annotations

import difflib
import html
import re
import unicodedata
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normal(x: Column) -> Column:
    """Lower case, other signs than a-z and 0-9 as single blanks, trimmed."""
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


@F.pandas_udf(T.StringType())
def _folded(x: pd.Series) -> pd.Series:
    def fold(v: str | None) -> str | None:
        if v is None:
            return None
        plain = "".join(c for c in unicodedata.normalize("NFKD", v.lower()) if not unicodedata.combining(c))
        return re.sub("[^a-z0-9]+", " ", plain).strip()

    return x.map(fold)


def folded(x: Column) -> Column:
    """``normal`` after compatibility decomposition without marks; plain ASCII never leaves the JVM."""
    return F.when(x.rlike(r"^[\x00-\x7f]*$"), normal(x)).otherwise(_folded(x))


@F.pandas_udf(T.StringType())
def _unmarked(x: pd.Series) -> pd.Series:
    drop = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->")
    blocks = re.compile(r"(?i)</?(p|div|br|li|ul|ol|tr|table|h[1-6]|section|article|header|footer)\b[^>]*>")

    def strip(v: str | None) -> str | None:
        if v is None:
            return None
        lines = html.unescape(re.sub("<[^>]*>", "", blocks.sub("\n", drop.sub("", v)))).split("\n")
        return "\n".join(t for t in (re.sub(r"\s+", " ", line).strip() for line in lines) if t)

    return x.map(strip)


def inert_text(markup: Column) -> Column:
    """The readable text of markup: block tags as line ends, scripts and comments gone, entities resolved."""
    return F.when(markup.rlike("[<&]"), _unmarked(markup)).otherwise(markup)


def tokens(x: Column, least: int = 1) -> Column:
    """Distinct words of ``normal`` text of at least a length; empty for null."""
    return F.array_distinct(F.filter(F.split(F.coalesce(normal(x), F.lit("")), " "), lambda w: F.length(w) >= least))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of arrays of distinct words; 0 where both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Common words over the smaller set's; 0 where one is empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))), F.lit(0.0))


@F.pandas_udf(T.DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two strings; null counts as empty."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


def place_similarity(a: Column, b: Column) -> Column:
    """The greater of word Jaccard and matching ratio of normal forms."""
    return F.greatest(jaccard(tokens(a), tokens(b)), matching_ratio(F.coalesce(normal(a), F.lit("")), F.coalesce(normal(b), F.lit(""))))


@F.pandas_udf(T.StringType())
def _unescaped(x: pd.Series) -> pd.Series:
    def one(v: str | None) -> str | None:
        if v is None:
            return None
        raw = unquote_to_bytes(v)
        try:
            plain = raw.decode()
        except UnicodeDecodeError:
            plain = raw.decode("cp1252", "replace")
        return unicodedata.normalize("NFKC", plain.replace("\xa0", " ").replace("\ufffd", " "))

    return x.map(one)


def unescaped(path: Column) -> Column:
    """A path with its percent escapes resolved, as UTF-8 or else as the western code page; plain ASCII stays in the JVM."""
    return F.when(path.rlike(r"^[\x00-\x24\x26-\x7f]*$"), path).otherwise(_unescaped(path))


def canonical_url(u: Column) -> Column:
    """Scheme and host in lower case, fragment dropped; null where it is no http address."""
    scheme, rest = F.lower(F.regexp_extract(u, r"^(?i)(https?)://", 1)), F.regexp_extract(u, r"(?i)^https?://([^#]*)", 1)
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    return F.when(scheme != "", F.concat(scheme, F.lit("://"), host, F.regexp_replace(rest, r"^[^/?]*", "")))


def url_key(u: Column) -> Column:
    """Host without www, path and query of an address: equal for what is one page; null where it is no http address.

    The path's escapes are resolved, as UTF-8 or else as the western code page, its blanks of any
    kind are single ones, its forms compatible ones; all in lower case. An empty query counts as none.
    """
    host = F.regexp_replace(F.lower(F.regexp_extract(u, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", "")
    path, query = F.regexp_extract(u, r"(?i)^https?://[^/?#]*([^?#]*)", 1), F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    path = F.lower(F.regexp_replace(unescaped(path), r"\s+", " "))
    query = F.lower(F.trim(F.regexp_replace(query, r"\s+", " ")))
    return F.when(u.rlike("(?i)^https?://"), F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def directory(u: Column) -> Column:
    return F.regexp_replace(u, "/[^/]*$", "/")


def links(text: Column) -> Column:
    """Addresses in a text in order, without repeats and trailing punctuation."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"https?://[^\s<>\"']+"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"[.,;:!?)\]]+$", "")))


def listed(x: Column, by: str = ";") -> Column:
    """Parts of a delimited list, trimmed, without empty ones; empty for null."""
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), by), lambda v: F.trim(v)), lambda v: v != "")


def given(x: Column) -> Column:
    """Null for the empty and the blank."""
    return F.nullif(F.trim(x), F.lit(""))


def stable_id(prefix: str, *parts: Column, bits: int = 1, length: int = 14) -> Column:
    """``prefix`` and the first hex digits of a hash of the parts joined by |; a missing part is empty."""
    joined = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(prefix), F.substring(F.sha1(joined) if bits == 1 else F.sha2(joined, bits), 1, length))


def flag(x: Column) -> Column:
    """A lenient boolean of text."""
    return F.coalesce(F.lower(F.trim(x)).isin("true", "1", "yes"), F.lit(False))
