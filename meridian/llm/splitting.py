"""Splitting long texts at natural boundaries by packing the subtrees of their structure."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.tokens import RANKS, load

# The structure of a text as cuts between its parts, from the strongest; a part keeps the break at its end.
_BREAK = r"(?:\r\n?|\n)"
_RULE = re.compile(rf"(?m)^(?=[=~]{{3,}}[^\S\r\n]*$|(?:-[^\S\r\n]?){{3,}}$|(?:\*[^\S\r\n]?){{3,}}$|<hr\b)")
_HEADING = re.compile(rf"(?m)^(?=(#{{1,6}})\s|<h([1-6])\b|\S[^\r\n]*{_BREAK}(?:(={{3,}})|(-{{3,}}))[^\S\r\n]*$)")
_TAG = re.compile(r"(?i)<(/?)(section|article|header|footer|main|aside|nav|div|blockquote|table|thead|tbody|tr|ul|ol|dl|li|dt|dd|p|pre|figure)\b[^>]*>")
_PARAGRAPH = re.compile(rf"{_BREAK}(?:[^\S\r\n]*{_BREAK})+")
_ITEM = re.compile(rf"{_BREAK}(?=([^\S\r\n]*)(?:[-*+•–]|\d{{1,3}}[.)]|\[\w+\]|>)\s)")
_LINE = re.compile(r"\r\n?|\n|\x0b|\x0c|\x85|\u2028|\u2029")
_SENTENCE = re.compile(r"[.!?…]+[\"'”’»)\]]*(?=\s)|[。！？]+[」』）]*")
_WORD = re.compile(r"\S(?=\s)")
#: Ranks of the levels, and the depths of headings, markup and lists that are told apart; deeper ones lie with the deepest.
HEADINGS, MARKUP, ITEMS = 6, 8, 4
_RANKS = {"rule": 0, "heading": 1, "markup": 1 + HEADINGS, "paragraph": 1 + HEADINGS + MARKUP, "item": 2 + HEADINGS + MARKUP, "line": 2 + HEADINGS + MARKUP + ITEMS, "sentence": 3 + HEADINGS + MARKUP + ITEMS, "word": 4 + HEADINGS + MARKUP + ITEMS}
_LEVELS = _RANKS["word"] + 1
_BELOW = (_LINE, _SENTENCE, _WORD)


def outline(text: str) -> list[list[int]]:
    """For each rank the offsets, in order, at which nodes of it may be cut into their children.

    Headings rank by their depth (``#`` to ``######``, ``<h1>`` to ``<h6>``, underlined ones as the
    first two), block tags by how many are open around them, list items by their indentation
    against the list's other items; paragraphs lie between. What is below, lines, sentences and
    words, is looked for only in nodes that are opened so far.
    """
    cuts: list[list[int]] = [[] for _ in range(_RANKS["line"])]
    marked = "<" in text
    if marked or "---" in text or "===" in text or "***" in text or "~~~" in text or "- -" in text or "* *" in text:
        cuts[0] = [m.start() for m in _RULE.finditer(text)]
    if marked or "#" in text or "---" in text or "===" in text:
        for m in _HEADING.finditer(text):
            depth = len(m[1]) if m[1] else int(m[2]) if m[2] else 1 if m[3] else 2
            cuts[_RANKS["heading"] + depth - 1].append(m.start())
    depth = 0
    for m in _TAG.finditer(text) if marked else ():
        depth = max(0, depth - 1) if m[1] else depth
        cuts[_RANKS["markup"] + min(depth, MARKUP - 1)].append(m.end() if m[1] else m.start())
        depth += not m[1] and m[2].lower() not in ("p", "li", "dt", "dd", "tr")  # whose end may be left out
    cuts[_RANKS["paragraph"]] = [m.end() for m in _PARAGRAPH.finditer(text)]
    indents: list[int] = []
    for m in _ITEM.finditer(text):
        width = len(m[1].expandtabs(4))
        while indents and indents[-1] > width:
            indents.pop()
        if not indents or indents[-1] < width:
            indents.append(width)
        cuts[_RANKS["item"] + min(len(indents), ITEMS) - 1].append(m.end())
    return cuts


class Ruler:
    """Token counts of ranges of one text."""

    def __init__(self, text: str, path: str) -> None:
        self.text, self.encoding = text, load(path)
        ids = self.encoding.encode_to_numpy(text)
        self.total = len(ids)
        self.starts: list[int] = []
        self.cuts: list[list[int]] = []
        self.ids = ids

    def place(self, lengths: np.ndarray) -> None:
        """Finds the text's structure, and the character at which each token starts from the tokens' lengths in bytes."""
        self.cuts = outline(self.text)
        ends = np.cumsum(lengths[self.ids])
        raw = np.frombuffer(self.text.encode(), np.uint8)
        self.starts = (np.cumsum((raw & 0xC0) != 0x80) - 1)[np.concatenate([[0], ends[:-1]])].tolist()

    def rough(self, a: int, b: int) -> int:
        """Tokens of the whole text that start in a range: near the range's own where it is cut between words."""
        return bisect_left(self.starts, b) - bisect_left(self.starts, a)

    def children(self, a: int, b: int, level: int) -> list[tuple[int, int]]:
        if level < len(self.cuts):
            own = self.cuts[level]
            cuts = own[bisect_right(own, a) : bisect_left(own, b)]
        else:
            cuts = [m.end() for m in _BELOW[level - len(self.cuts)].finditer(self.text, a, b) if a < m.end() < b]
        return list(zip([a, *cuts], [*cuts, b]))

    def exact(self, a: int, b: int) -> int:
        return len(self.encoding.encode_to_numpy(self.text[a:b]))


def _leaves(ruler: Ruler, a: int, b: int, level: int, limit: int) -> list[tuple[int, int]]:
    """Ranges of about ``limit`` tokens at most that tile [a, b): siblings merged, large nodes opened."""
    if ruler.rough(a, b) <= limit:
        return [(a, b)]
    if level == _LEVELS:  # one unbroken run: cut at tokens' starts
        out = []
        while a < b:
            k = bisect_left(ruler.starts, a) + limit
            cut = max(a + 1, min(b, ruler.starts[k])) if k < ruler.total else b
            out.append((a, cut))
            a = cut
        return out
    out = []
    open_a = None  # start of the group of whole siblings that is being merged
    for x, y in ruler.children(a, b, level):
        if open_a is not None and ruler.rough(open_a, y) <= limit:
            out[-1] = (open_a, y)
            continue
        below = _leaves(ruler, x, y, level + 1, limit)
        out += below
        open_a = below[-1][0]
    return out


def _overlap_start(ruler: Ruler, a: int, floor: int, overlap: int) -> int:
    """Where a piece of new text from ``a`` begins, so that it repeats at most ``overlap`` tokens."""
    text = ruler.text
    least = max(ruler.starts[max(bisect_left(ruler.starts, a) - overlap, 0)], floor)
    low = least
    while low < a and not (text[low].isspace() or text[low - 1].isspace()):
        low += 1
    if ruler.rough(low, a) < overlap * 3 // 4:  # a script without blanks, or a very long word
        low = least
    while low < a and ruler.exact(low, a) > overlap:
        low = min(a, ruler.starts[min(bisect_right(ruler.starts, low), ruler.total - 1)])
    return min(low, a)


def split_text(text: str, limit: int, overlap: int, path: str, lengths: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of a text's pieces in order; offsets in characters.

    A text within the limit is one piece. Otherwise pieces tile the text, and each but the first
    also begins with the end of the one before: as many whole words as fit ``overlap`` tokens, or,
    where those would be under three quarters of it, as many characters. Every piece is counted
    by itself; one that exceeds the limit after all is packed again under a lower limit.
    """
    ruler = Ruler(text, path)
    if ruler.total <= limit:
        return [(0, len(text), ruler.total)]
    ruler.place(lengths)
    tiles = _leaves(ruler, 0, len(text), 0, limit - overlap - 2)
    if len(tiles) > 1 and ruler.rough(tiles[0][0], tiles[1][1]) <= limit - 2:
        tiles[:2] = [(tiles[0][0], tiles[1][1])]
    out, queue, body = [], tiles[::-1], limit - overlap
    while queue:
        a, b = queue.pop()
        start = _overlap_start(ruler, a, out[-1][0] + 1, overlap) if out else a
        n = ruler.exact(start, b)
        if n > limit:
            body = max(1, min(ruler.rough(a, b), body) * 3 // 4)
            finer = _leaves(ruler, a, b, 0, body)
            if len(finer) == 1 and b - a > 1:
                mid = (a + b) // 2
                finer = [(a, mid), (mid, b)]
            queue += finer[::-1]
            continue
        body = limit - overlap
        out.append((start, b, n))
    return out


def split_documents(docs: DataFrame, key: str, text: str, limit: int = 512, overlap: int = 64, path: str = RANKS) -> DataFrame:
    """Ordered pieces of every text of more than ``limit`` tokens: key, piece, start, end, tokens, text.

    A text is a tree of headings by depth, blocks of markup as they nest, paragraphs, items of lists
    as they are indented, lines, sentences and words; it is cut where that keeps larger subtrees
    whole; inside a word only if it exceeds the limit alone. Consecutive pieces share at
    most ``overlap`` tokens. Null, empty and short texts give no rows; repeated rows give their
    pieces again; other columns are ignored. The work is one text at a time with no shuffle.
    """
    kind = docs.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = load(path)
        lengths = np.array([len(encoding.decode_single_token_bytes(i)) for i in range(encoding.n_vocab)])
        for pdf in batches:
            rows = []
            for k, t in zip(pdf["k"], pdf["t"]):
                pieces = split_text(t, limit, overlap, path, lengths)
                if len(pieces) > 1:
                    rows += [(k, i, a, b, n, t[a:b]) for i, (a, b, n) in enumerate(pieces)]
                if len(rows) > 5000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    names = ["k", "piece", "start", "end", "tokens", "text"]
    # A token is at least one byte, so shorter texts can't exceed the limit.
    long = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.octet_length("t") > limit)
    return long.mapInPandas(cut, f"k {kind}, piece int, start int, `end` int, tokens int, text string").withColumnRenamed("k", key)
