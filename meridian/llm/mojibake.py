"""Text decoded with the wrong character encoding: candidates, and their description lengths.

A chain of steps leads from a garbled text to a candidate: each step writes the text in an
encoding that it may have been read in, and reads those bytes as what they may have been. Every
candidate is compressed with a zstandard dictionary of each language; the chain of the least
description length, the cost of the chain included, is chosen, else the text stays as it is.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.runtime import written

# Encodings that bytes of UTF-8 are mistaken for, and pairs (mistaken for, meant) of one-byte and double-byte ones.
READ_AS = ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "iso8859_2", "cp1251", "koi8_r", "cp866", "cp1253", "iso8859_7", "cp1254", "iso8859_15"]
MEANT = [
    ("cp1252", "cp1251"), ("latin-1", "cp1251"), ("cp1252", "cp1250"), ("latin-1", "iso8859_2"), ("cp1252", "iso8859_2"), ("cp1252", "cp1253"), ("latin-1", "iso8859_7"),
    ("cp1252", "koi8_r"), ("latin-1", "koi8_r"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("latin-1", "cp437"), ("latin-1", "cp850"), ("cp437", "cp1252"), ("cp850", "cp1252"),
    ("cp437", "latin-1"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("latin-1", "mac_roman"), ("cp1250", "cp1252"), ("iso8859_2", "cp1252"), ("cp1251", "cp1252"), ("cp866", "cp1251"), ("cp1251", "cp866"),
    ("cp1252", "cp866"), ("cp437", "cp866"), ("cp1252", "cp932"), ("latin-1", "cp932"), ("latin-1", "euc_jp"), ("cp1252", "euc_jp"), ("cp1253", "cp1252"), ("cp1252", "cp852"), ("cp852", "cp1250"), ("cp437", "cp852"), ("cp850", "cp852"), ("cp1254", "cp1252"),
]
# The letters beyond a to z of the languages told apart, and signs common to all.
LETTERS = {
    "en": "", "de": "äöüßÄÖÜ", "fr": "àâæçéèêëîïôœùûüÿÀÂÆÇÉÈÊËÎÏÔŒÙÛÜ", "es": "áéíóúüñÁÉÍÓÚÜÑ", "pt": "áâãàçéêíóôõúÁÂÃÀÇÉÊÍÓÔÕÚ", "it": "àèéìíîòóùúÀÈÉÌÒÙ", "nl": "áéíóúëïöüÉË",
    "sv": "åäöéÅÄÖÉ", "da": "æøåéÆØÅÉ", "pl": "ąćęłńóśźżĄĆĘŁŃÓŚŹŻ", "cs": "áčďéěíňóřšťúůýžÁČĎÉĚÍŇÓŘŠŤÚŮÝŽ", "ro": "ăâîșțşţĂÂÎȘȚ",
    "el": "αβγδεζηθικλμνξοπρσςτυφχψωάέήίόύώϊϋΐΰΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩΆΈΉΊΌΎΏ", "ru": "абвгдеёжзийклмнопрстуфхцчшщъыьэюяАБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
}
SIGNS = "–—‘’“”„«»‹›…°№©½¼¾²³£€ºª¿¡・「」『』、。"
#: Bytes that a step of a chain costs: one out of UTF-8, and the rarer one from letters to letters. By MARGIN the
#: description must fall short of the text's own.
STEP_COST, SWAP_COST, MARGIN = 1, 1.25, 0.5
#: Steps of a chain: texts are garbled twice, seldom three times.
STEPS = 3
#: Size of a language's dictionary.
DICTIONARY_BYTES = 8192
#: Texts that a task reads, so that tasks stay short however many texts there are.
TASK_TEXTS = 5000
# What stands in no word: a sign between letters, and a marked capital after a small letter.
_SIGN_IN_WORD = re.compile("(?<=[^\\W\\d_])[¡-©«¬®-¶¸¹»-¿×÷‚„†‡‰‹›€™─-╿√∞≈≤≥∂∆∏∑∫Ω¨´](?=[^\\W\\d_])|(?<=[a-zß-öø-ÿ])[À-ÖØ-ÞŒŸŠŽ]")
_HOPELESS = re.compile("[�\x80-\x9f]")


def _table(encoding: str) -> dict[str, int]:
    """Byte of each character of a one-byte encoding; undefined bytes are their control characters."""
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    if encoding in ("cp1252", "cp1254"):
        out |= {chr(b): b for b in range(128, 160) if chr(b) not in out}
    return out


_BYTES = {e: _table(e) for e in dict.fromkeys([*READ_AS, *(a for a, _ in MEANT)])}


def _leads(encoding: str) -> re.Pattern[str]:
    """Where ``from_utf8`` may find something: a lead byte's character and a tail byte's, or what stands for them."""
    western = encoding in ("cp1252", "latin-1")
    every = lambda low, high: {v for c, b in _BYTES[encoding].items() if low <= b <= high for v in ((c, c.upper(), c.lower()) if western else (c,)) if len(v) == 1}
    sign = lambda cs: "[" + "".join(map(re.escape, sorted(cs))) + "]"
    return re.compile(sign(c for c in every(0xC2, 0xF4) if ord(c) > 127) + sign(every(0x80, 0xBF)) + ("|Ã " if western else ""))


_LEADS = {e: _leads(e) for e in READ_AS}


def suspicious(text: Column) -> Column:
    """False only where ``readings`` of a text are none and nothing in it is lost: told without leaving the JVM.

    That is, no pair of characters may be a run of UTF-8, no sign or capital stands inside a word, and
    some language spells the text.
    """
    java = lambda chars: "".join(f"\\x{{{ord(c):x}}}" for c in chars)
    shared = rf"\x00-\x7f\p{{Zs}}\p{{Cf}}{java(SIGNS)}"
    spelled = "|".join(f"[{shared}{java(letters)}]*" for letters in LETTERS.values()) + rf"|[{shared}\x{{3041}}-\x{{3096}}\x{{30a1}}-\x{{30fa}}\x{{4e00}}-\x{{9fff}}]*"
    runs = "|".join(p.pattern if p.pattern.isascii() else re.sub(r"[^\x00-\x7f]", lambda m: java(m[0]), p.pattern) for p in _LEADS.values())
    letter = r"[\p{L}\p{Nl}\p{No}]"
    inside = re.sub(r"[^\x00-\x7f]", lambda m: java(m[0]), _SIGN_IN_WORD.pattern.replace(r"[^\W\d_]", letter))
    return ~text.rlike(f"^(?:{spelled})$") | text.rlike(runs) | text.rlike(inside) | text.rlike(r"[\x{fffd}\x80-\x9f]")


_COMMON = {*"".join(LETTERS.values()), *SIGNS}


def _reading(char: str) -> bool:
    """Whether a decoded character may be meant: a letter or sign in use, or one that a further step takes on."""
    return char in _COMMON or 0x80 <= ord(char) <= 0x24F or 0x400 <= ord(char) <= 0x45F or (char.isprintable() and unicodedata.name(char, "").startswith(("GREEK", "CJK", "HIRAGANA", "KATAKANA", "IDEOGRAPHIC", "FULLWIDTH", "BOX", "EURO", "TRADE", "SINGLE", "DOUBLE", "DAGGER", "PER MILLE", "BULLET", "SMALL TILDE", "NUMERO", "DOT ABOVE", "BREVE", "CARON", "OGONEK")))


def from_utf8(text: str, encoding: str) -> str:
    """``text`` with every run of characters that spells UTF-8 in ``encoding`` read as UTF-8.

    What later hands did is allowed for in the commonest encodings: letters of another case, a
    blank for the no-break space after Ã, and a closing quote whose last byte was lost.
    """
    table, western = _BYTES[encoding], encoding in ("cp1252", "latin-1")
    out, i, n = [], 0, len(text)
    while i < n:
        c = text[i]
        cased = [v for v in (c.upper(), c.lower()) if v != c and len(v) == 1] if western else []
        for form in [c, *cased] if ord(c) > 127 else ():
            lead = table.get(form, 0)
            if not 0xC2 <= lead <= 0xF4:
                continue
            size = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            tails, exact = [], form == c
            for t in text[i + 1 : i + size]:
                at = next((v for v in ((t, t.upper(), t.lower()) if western else (t,)) if 0x80 <= table.get(v, 0) <= 0xBF), None)
                if at is None:
                    break
                exact &= at == t
                tails.append(table[at])
            if len(tails) == size - 1:
                try:
                    char = bytes([lead, *tails]).decode()
                except UnicodeDecodeError:
                    continue
                if _reading(char) if exact else char in _COMMON:
                    out.append(char)
                    i += size
                    break
            elif western and lead == 0xE2 and tails == [0x80] and exact:
                out.append("”")
                i += 3 if text[i + 2 : i + 3] in ("Â", "Ã") else 2
                break
            elif western and c == "Ã" and text[i + 1 : i + 2] == " ":
                out.append("à")
                i += 2 if text[i + 2 : i + 3] == " " else 1
                break
        else:
            out.append(c)
            i += 1
    return "".join(out)


def _letters(read: str, meant: str) -> dict[int, str]:
    """What each character of a one-byte encoding is in another one, where it is printable there."""
    out = {}
    for c, b in _BYTES[read].items():
        try:
            other = bytes([b]).decode(meant)
        except UnicodeDecodeError:
            continue
        if other.isprintable():
            out[ord(c)] = other
    return out


_SWAPS = {(read, meant): _letters(read, meant) for read, meant in MEANT if meant not in ("cp932", "euc_jp")}


def _swap(text: str, odd: set[int], read: str, meant: str) -> str | None:
    """``text``, whose characters beyond ASCII are ``odd``, written in ``read`` and read in ``meant``."""
    if (read, meant) in _SWAPS:
        letters = _SWAPS[read, meant]
        return text.translate(letters) if odd <= letters.keys() else None
    table = _BYTES[read]
    try:
        out = bytes(b for c in text for b in ([ord(c)] if ord(c) < 128 else [table[c]])).decode(meant)
    except (KeyError, UnicodeDecodeError):
        return None
    return out if out.isprintable() else None


def fitting(text: str) -> list[str]:
    """Languages whose letters and signs are all that a text has beyond ASCII."""
    rest = {c for c in text if ord(c) > 127 and c not in SIGNS and unicodedata.category(c) not in ("Zs", "Cf")}
    fit = [lang for lang, letters in LETTERS.items() if rest <= set(letters)]
    if rest and all(unicodedata.name(c, "").startswith(("CJK", "HIRAGANA", "KATAKANA", "IDEOGRAPHIC")) for c in rest):
        fit.append("ja")
    return fit


def readings(text: str) -> dict[str, float]:
    """What one step makes of a text, each other reading once, and the step's cost.

    One encoding of single letters is read as another only where no language spells the text, and
    only into what one may spell: the compressor cannot tell one sound letter from another.
    """
    out: dict[str, float] = {from_utf8(text, e): STEP_COST for e in READ_AS if _LEADS[e].search(text)}
    if odd_signs(text) or not fitting(text):
        odd = {ord(c) for c in text if ord(c) > 127}
        swaps = (_swap(text, odd, read, meant) for read, meant in MEANT)
        out = {c: SWAP_COST for c in swaps if c and not odd_signs(c) and all(x in _COMMON or fitting(x) for x in c if ord(x) > 127)} | out
    out.pop(text, None)
    return out


def odd_signs(text: str) -> int:
    return len(_SIGN_IN_WORD.findall(text))


class Scale:
    """Description length of a text in bytes: the least compressed size over the languages' dictionaries.

    On a text of thirty bytes the compressor sees no single damaged letter; so a sign or marked
    capital inside a word, which no language spells, is described too, in ``sign`` bytes: what an
    event of its frequency in the training texts takes.
    """

    def __init__(self, dictionaries: dict[str, bytes], sign: float) -> None:
        import zstandard

        self.by, self.sign = {}, sign
        for lang, raw in dictionaries.items():
            d = zstandard.ZstdCompressionDict(raw)
            self.by[lang] = zstandard.ZstdCompressor(level=9, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

    def length(self, text: str) -> float:
        raw = text.encode("utf-8", "replace")
        return min((len(c.compress(raw)) for c in self.by.values()), default=len(raw)) + self.sign * odd_signs(text)


def choose(text: str, scale: Scale) -> tuple[str, int]:
    """(best reading, steps); the text itself with no step where no chain describes it in less.

    Every reading of a step is compressed. Those that describe what they were read from in less are
    read again, up to ``STEPS`` times: a chain goes on as long as it gets shorter.
    """
    own = scale.length(text)
    known, best, frontier = {text: own}, (own, 0, text), {text: 0.0}
    for turn in range(1, STEPS + 1):
        fresh: dict[str, float] = {}
        for t, paid in frontier.items():
            for c, cost in readings(t).items():
                if c not in known:
                    known[c] = scale.length(c)
                if known[c] < known[t]:
                    fresh[c] = min(fresh.get(c, math.inf), paid + cost)
                best = min(best, (known[c] + paid + cost, turn, c))
        frontier = fresh
    return (best[2], best[1]) if best[1] and best[0] + MARGIN <= own else (text, 0)


def simpler(form: str, best: str, scale: Scale) -> bool:
    """Whether another form of a text has no reading itself and is described in less than the text's best reading."""
    return scale.length(form) < scale.length(best) and not choose(form, scale)[1]


def train(texts: DataFrame) -> tuple[dict[str, bytes], float]:
    """A dictionary of each language, and the bytes that a sign inside a word takes.

    ``texts`` (column text, each once) all train, each every language whose letters are its own. Texts
    that a chain could change, or that hold characters of no language, train nothing. The trainer
    reads all texts of a language, of which it would hold a quarter back, in one task a language:
    its memory grows with them. Only the dictionaries and two sums come to the driver.
    """

    def trained(pdf: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        samples = sorted(t.encode("utf-8", "replace") for t in pdf["text"])
        try:
            raw = zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=9, split_point=1.0).as_bytes()
        except zstandard.ZstdError:  # too few samples: they are the dictionary
            raw = b"\n".join(samples)[-DICTIONARY_BYTES:]
        return pd.DataFrame({"lang": pdf["lang"].iloc[:1], "dictionary": [raw]})

    def sort_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for t in pdf["text"]:
                fit = fitting(t)
                if fit and not any(_LEADS[e].search(t) and from_utf8(t, e) != t for e in READ_AS if e not in ("cp866", "koi8_r")):
                    inside = sum(a.isalpha() and b.isalpha() for a, b in zip(t, t[1:]))
                    rows += [(f, t, inside if f == fit[0] else 0, odd_signs(t) if f == fit[0] else 0) for f in fit]
            yield pd.DataFrame(rows, columns=["lang", "text", "inside", "signs"])

    odd = F.col("text").rlike(r"[^\x00-\x7f]")
    plain = texts.where(~odd).select(F.lit("en").alias("lang"), "text", F.regexp_count("text", F.lit("[A-Za-z](?=[A-Za-z])")).cast("long").alias("inside"), F.lit(0).cast("long").alias("signs"))
    clean = written(plain.unionByName(texts.where(odd).mapInPandas(sort_out, "lang string, text string, inside long, signs long")), "clean")
    inside, signs = clean.agg(F.coalesce(F.sum("inside"), F.lit(0)), F.coalesce(F.sum("signs"), F.lit(0))).first()
    by = clean.select("lang", "text").repartition(len(LETTERS) + 1, "lang").groupBy("lang")
    out = {r["lang"]: bytes(r["dictionary"]) for r in by.applyInPandas(trained, "lang string, dictionary binary").collect()}
    return dict(sorted(out.items())), math.log2((inside + 2) / (signs + 1)) / 8


def repair(rows: DataFrame, key: str, text: str, corpus: DataFrame | None = None, rival: str | None = None) -> DataFrame:
    """(key, text, restored, steps, lost) of every row whose text is garbled.

    ``restored`` is the reading of least description length; where characters were lost for good
    (replacement or control characters remain), ``lost`` is true and as much is restored as can
    be. Null, empty and plain ASCII texts are never garbled. Repeated rows come out as often as
    they went in, null keys too; equal texts are read once. An empty table gives no rows. The
    dictionaries are trained on ``corpus``, of which ``rows`` may be a part, else on ``rows``. The
    column ``rival``, if any, holds one other form of each text: where it says the text in less than
    the best reading does, the text is not garbled, unless characters were lost.
    """
    odd = rows.where(F.col(text).rlike(r"[^\x00-\x7f]"))
    form = F.coalesce(F.col(rival), F.lit("")) if rival else F.lit("")
    texts = odd.where(suspicious(F.col(text))).select(F.col(text).alias("text"), form.alias("form")).distinct()
    corpus = rows if corpus is None else corpus
    dictionaries, sign = train(corpus.where(F.length(text) > 0).select(F.col(text).alias("text")).distinct())

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scale = Scale(dictionaries, sign)
        for pdf in batches:
            out = []
            for t, other in zip(pdf["text"], pdf["form"]):
                best, steps = choose(t, scale)
                lost = bool(_HOPELESS.search(best))
                if lost or (steps and not (other and simpler(other, best, scale))):
                    out.append((t, best, steps, lost))
            yield pd.DataFrame(out, columns=["t", "restored", "steps", "lost"])

    least = 2 * rows.sparkSession.sparkContext.defaultParallelism
    spread = max(least, math.ceil(rows.count() / TASK_TEXTS))
    found = texts.repartition(spread).mapInPandas(read, "t string, restored string, steps int, lost boolean")
    return odd.select(F.col(key).alias("__k"), F.col(text).alias("t")).join(found, "t").select(F.col("__k").alias(key), F.col("t").alias(text), "restored", "steps", "lost")
