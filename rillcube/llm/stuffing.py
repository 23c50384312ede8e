"""Keyword-stuffed, link-list, menu and product-tag pages (problem 9).

Every line of a page is cut into units (sentences by their end marks, and within them clauses by list separators), and
each unit is reduced to a shape: buckets of its word count, its capitals, its separators, whether it bears links, tags
or product codes, and how it ends.  No list of words is involved.  A shape is a sentence's if it begins with a capital and
ends with an end mark (or has the length of a sentence and one of the two), if its clauses are of some words each, and
if words do not keep coming back: the same word three times within the unit, a word that dominates the page twice in a short
unit, or units amid a stretch of the page whose words are few and mixed anew again and again.  Words that stand at the
same place of many units are a pattern of sentences and no keywords.  Characters are summed by shape within the page, and a
page is flagged whose non-sentence shapes hold more than half of its characters.  All of this is per row: an Arrow UDF
over the text column, without any shuffle, and a host or source with a third of all rows costs the same per row as any
other.

Defined results: null, empty and blank texts have no shapes and are not flagged; a page with fewer than ``MIN_ITEMS``
non-sentence units is not flagged (a lone fragment is no list) unless links, codes and tags alone hold more than half of it; texts are read whole; repeated rows are judged alike;
further columns are kept, but one of the result's name is replaced.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter, defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE, TOP_SHAPES, MIN_ITEMS = 0.5, 12, 3
#: A word dominates a page from this share of its keywords and this often; short units have so many words at most.
DOMINATES, DOMINATES_TIMES, SHORT = 0.15, 3, 6
#: A word that stands at the same place of its units in this share of its occurrences, and this often, is a pattern's.
PATTERN_SHARE, PATTERN_TIMES = 0.7, 3
#: A stretch of so many keywords is poor with this share of different ones; for units that lack a capital or an end mark the second.
STRETCH, POOR, POOR_PARTS = 24, 0.5, 0.62
#: Words of a clause, and of a unit that lacks a capital or an end mark, at least; clauses below that, at most.
CLAUSE_WORDS, UNIT_WORDS, SHORT_CLAUSES = 3, 5, 2
#: A unit is damaged text from this share of unprintable characters, or of letters in words of more than LONG letters.
DAMAGED_SIGNS, DAMAGED_LETTERS, LONG = 0.04, 0.5, 40

_LINK = re.compile(r"<a\s[^<>]*>.*?</a>|\[[^\[\]\n]*\]\([^)\s]*\)|(?:https?://|www\.)[^\s<>|,;]+|(?<![\w@.-])(?:[\w-]+\.)+[a-z]{2,}/[^\s<>|,;]*", re.I)
_END = re.compile(r"(?<=[.!?…])[\"”»“’')\]]*(?:\s+|$)|[。！？](?:[”」』])?")
_CODE = re.compile(r"\b[A-Z]{2,}[-/ ]?\d{2,}\b")
_MARK = re.compile(r"<\w+>|(?<!\w)#\w")
_SEPARATOR = re.compile(r"[,;:|>»·•*#=，、；：/\\]+|\s[-–]\s|<\w*>?")
_SPACE = re.compile(r"[\u00a0\u2000-\u200b\u202f\u3000\r]")
_WIDE = re.compile(r"\s{2,}|\t")
_WIDE_GAP = re.compile(r"[^\S\n]{2}|\t")
_WORD = re.compile(r"[㐀-鿿]|[^\W\d_㐀-鿿]+")
_LABEL = re.compile(r"[^\W\d_]+: (?=\S)")
_CLOSING, _ENDS = "\"”“»«’')]」』", (".", "!", "?", "…", "。", "！", "？")
_FIRST = re.compile(r"\w")


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _sign(word: str) -> bool:
    return "㐀" <= word <= "鿿"


def _length(words: list[str]) -> float:
    """Words; two Chinese signs count as one."""
    return len(words) - sum(map(_sign, words)) / 2 if words and max(words) >= "㐀" else len(words)


@dataclass(slots=True)
class _Unit:
    text: str
    chars: int
    words: list[str]
    length: float
    clauses: list[tuple[int, float, str]]  # characters, length, last word
    codes: int
    marks: int
    keys: list[str]


def _bucket(n: float) -> str:
    return "0" if n < 1 else "1" if n < 2 else "2" if n < 4 else "4" if n < 8 else "8" if n < 16 else "16"


def _shape(unit: str, length: float, separators: int, links: bool, marks: bool, codes: bool) -> str:
    caps = "A" if unit.isupper() else "C" if _begins(unit) else "a"
    flags = ("L" if links else "") + ("T" if marks else "") + ("N" if codes else "")
    return f"{_bucket(length)}{caps}{_bucket(separators)}{flags}{'.' if _ended(unit) else '-'}"


def _begins(unit: str) -> bool:
    """Whether a unit begins as a sentence: its first letter is no small one."""
    first = _FIRST.search(unit)
    return first is not None and not first.group().islower() and unit[:1] not in "#<*"


def _ended(unit: str) -> bool:
    return unit.rstrip(_CLOSING).endswith(_ENDS)


def _damaged(unit: str, words: list[str]) -> bool:
    """Whether a unit is damaged text without word borders, not just one that holds a stray sign or an overlong word."""
    if not unit.isprintable():
        seen = [c for c in unit if not (c < " " or unicodedata.category(c) == "Cf")]
        if sum(not c.isprintable() for c in seen) >= DAMAGED_SIGNS * max(1, len(seen)):
            return True
    return sum(len(w) for w in words if len(w) > LONG) >= DAMAGED_LETTERS * sum(map(len, words))


def _units(line: str):
    """The sentences of a line, each with its end mark."""
    at = 0
    for m in _END.finditer(line):
        if m.end() > at:
            yield line[at : m.end()]
            at = m.end()
    if at < len(line):
        yield line[at:]


class _Page:
    """The shapes of one text."""

    def __init__(self, text: str):
        self.total = self.items = self.sure = 0
        self.by_shape: dict[str, int] = defaultdict(int)
        self.units: list[_Unit] = []
        text = _SPACE.sub(" ", html.unescape(text) if "&" in text else text)
        # what a text does not have anywhere need not be looked for in its lines
        self.has_links, self.has_codes, self.has_marks, self.has_wide = (p.search(text) is not None for p in (_LINK, _CODE, _MARK, _WIDE_GAP))
        for line in text.split("\n"):
            line = line.strip()
            if line:
                self.total += len(line)
                self._line(line)
        if self.units:
            self._weigh_words()
            for unit in self.units:
                if not self._sentence(unit):
                    self._list(unit)

    def _spam(self, shape: str, chars: int, items: int, certain: bool = False) -> None:
        self.by_shape[shape] += chars
        self.items += items
        self.sure += chars if certain else 0

    def _line(self, line: str) -> None:
        links = _LINK.findall(line) if self.has_links else []
        if links:
            rest = _LINK.sub(" ", line)
            beside = _length(_words(rest))
            # what stands beside the links: a sentence, or labels
            if beside / len(links) < 6:
                self._spam(_shape(line, beside, len(links), True, False, False), len(line), len(links), True)
                return
            self._spam("L", len(line) - len(rest), len(links), True)
            line = rest.strip()
        if self.has_wide and len(_WIDE.findall(line)) >= 2:
            parts = [p for p in _WIDE.split(line) if p]
            small = sum(not p[:1].isupper() for p in parts) / len(parts)
            if small >= (0.5 if _END.search(line) else 0.6):
                line = _WIDE.sub(" ", line)  # prose with wide blanks
            else:
                entries = [p for p in parts if not _ended(p) and _length(_words(p)) <= 4]
                if len(entries) > 2:
                    chars = len(line) - sum(len(p) for p in parts) + sum(map(len, entries))
                    self._spam(_shape(line, _length(_words(" ".join(entries))), len(entries), False, False, False), chars, len(entries))
                    parts = [p for p in parts if _ended(p) or _length(_words(p)) > 4]
                    if not parts:
                        return
                    line = " ".join(parts)
        for text in _units(line):
            unit = text.strip()
            if not unit:
                continue
            label = _LABEL.match(unit)
            if label and _ended(unit) and _length(_words(unit[label.end() :])) >= UNIT_WORDS:
                unit = unit[label.end() :]  # who speaks, or what a sentence is about
            codes = len(_CODE.findall(unit)) if self.has_codes else 0
            marks = len(_MARK.findall(unit)) if self.has_marks else 0
            cut = [c for c in _SEPARATOR.split(unit) if c and not c.isspace()]
            found = [_words(c) for c in cut]
            words = _words(_CODE.sub(" ", unit)) if codes else found[0] if len(found) == 1 else [w for f in found for w in f]
            length = _length(words)
            if not words or marks >= 2 or codes >= 2:
                if words or len(unit) > 2:
                    certain = bool(codes or marks >= 2)
                    self._spam(_shape(unit, length, len(cut), False, marks > 0, codes > 0), len(text), max(1, marks, codes), certain)
                continue
            clauses = [(len(unit) if len(cut) == 1 else len(c), _length(f), f[-1] if f else "") for c, f in zip(cut, found)]
            self.units.append(_Unit(unit, len(text), words, length, clauses, codes, marks, []))

    def _weigh_words(self) -> None:
        """The units' keywords, the words that dominate the page, and the share of each word that stands in poor stretches."""
        ends: Counter[str] = Counter()
        counts: Counter[str] = Counter()
        for unit in self.units:
            counts.update(unit.words)
            ends.update(last for _, _, last in unit.clauses)
        # a short word is a keyword only if clauses end with it now and then, as they do not with an article or a preposition
        keyword = {w for w, n in counts.items() if len(w) > 3 or (len(w) > 1 and ends[w] > 1 and 8 * ends[w] >= n)}
        often = {w for w in keyword if counts[w] >= PATTERN_TIMES}
        places: Counter[tuple[str, int]] = Counter()
        if often:
            for unit in self.units:
                places.update((w, place) for place, w in enumerate(unit.words) if w in often)
        pattern = {w for (w, _), n in places.items() if n >= PATTERN_SHARE * counts[w]}
        flow: list[str] = []
        seen: set[str] = set()
        for unit in self.units:
            unit.keys = [w for w in unit.words if w in keyword]
            if unit.length < len(unit.words):
                unit.keys += [a + b for a, b in zip(unit.words, unit.words[1:]) if _sign(a) and _sign(b)]
            if unit.text not in seen:  # a sentence that is repeated as a whole says nothing of its words
                flow += [k for k in unit.keys if k not in pattern]
            if _begins(unit.text) and _ended(unit.text):
                seen.add(unit.text)
        held = Counter(flow)
        poor: dict[float, Counter[str]] = {POOR: Counter(), POOR_PARTS: Counter()}
        for at in range(0, len(flow), STRETCH):
            stretch = flow[max(0, min(at, len(flow) - STRETCH)) : at + STRETCH]
            different = len(set(stretch)) / len(stretch)
            for least, words in poor.items():
                if 2 * len(stretch) >= STRETCH and different <= least:
                    words.update(flow[at : at + STRETCH])
        self.held, self.poor, self.pattern = held, poor, pattern
        self.dominant = {w for w, n in held.items() if n >= DOMINATES_TIMES and n >= DOMINATES * len(flow)}

    def _repeats(self, unit: _Unit, whole: bool) -> bool:
        """Whether a unit is built around words that keep coming back; ``whole`` if it has a capital and an end mark."""
        if not unit.keys:
            return False
        counts = Counter(unit.keys)
        most = len(unit.keys) - len(counts) and max(counts.values())  # 0 if none is there twice
        if most >= 3 and (4 * most > len(unit.words) or max(Counter(zip(unit.keys, unit.keys[1:])).values()) > 1):
            return True
        if most == 2 and unit.length <= SHORT and any(n == 2 and w in self.dominant for w, n in counts.items()):
            return True
        if len(unit.words) > SHORT and _ended(unit.text) and len(self.pattern & counts.keys()) > 1:
            return False  # one of many sentences of one pattern
        poor = self.poor[POOR if whole else POOR_PARTS]
        return bool(poor) and 2 * sum(poor[k] for k in counts) > sum(self.held[k] for k in counts)

    def _sentence(self, unit: _Unit) -> bool:
        short = sum(n < CLAUSE_WORDS for _, n, _ in unit.clauses)
        length, begins, ended = unit.length, _begins(unit.text), _ended(unit.text)
        if short > SHORT_CLAUSES or short == len(unit.clauses) or length < CLAUSE_WORDS or self._repeats(unit, begins and ended):
            return False
        if begins and ended:
            return True
        if length < UNIT_WORDS or short > 1:
            return False
        if ended:
            return short == 0 or len(unit.clauses) <= 2 or length > 2 * CLAUSE_WORDS
        if length < len(unit.words):  # Chinese has no capitals
            return short == 0 and len(unit.clauses) > 1
        capitals = sum(w[:1].isupper() for w in unit.text.split())
        return begins and 2 * capitals <= len(unit.text.split())

    def _list(self, unit: _Unit) -> None:
        if _damaged(unit.text, unit.words):
            return  # no list
        short = sum(n < CLAUSE_WORDS for _, n, _ in unit.clauses)
        chars, (first, words, _) = unit.chars, unit.clauses[0]
        if short > SHORT_CLAUSES and words >= CLAUSE_WORDS and _begins(unit.text):
            chars -= first  # a sentence in front of a list
        around = any(unit.keys.count(w) > 1 for w in self.dominant)
        items = max(1 + around, short, int(unit.length) // 4)
        self._spam(_shape(unit.text, unit.length, len(unit.clauses), False, unit.marks > 0, unit.codes > 0), chars, items, unit.codes > 0)

    @property
    def stuffed(self) -> bool:
        return sum(self.by_shape.values()) > SHARE * self.total and (self.items >= MIN_ITEMS or self.sure > SHARE * self.total)


def shapes(text: str) -> tuple[int, dict[str, int], int]:
    """(characters, characters by non-sentence shape, number of non-sentence units)."""
    page = _Page(text)
    return page.total, page.by_shape, page.items


def is_stuffed(text: str | None) -> bool:
    return bool(text) and _Page(text).stuffed


_RESULT = "struct<chars: int, list_chars: int, lists: int, stuffed: boolean>"


def _judge(texts: pa.Array) -> pa.Array:
    chars, listed, lists, stuffed = [], [], [], []
    for text in texts.to_pylist():
        page = _Page(text or "")
        chars.append(page.total)
        listed.append(sum(sorted(page.by_shape.values(), reverse=True)[:TOP_SHAPES]))
        lists.append(page.items)
        stuffed.append(page.stuffed)
    whole = [pa.array(x, pa.int32()) for x in (chars, listed, lists)]
    return pa.StructArray.from_arrays([*whole, pa.array(stuffed, pa.bool_())], names=["chars", "list_chars", "lists", "stuffed"])


def judge_pages(df: DataFrame, text: str = "text", into: str = "page") -> DataFrame:
    """``df`` with a struct column ``into``: ``chars`` (of the stripped lines), ``list_chars`` (in the few largest non-sentence shapes), ``lists`` (non-sentence units) and ``stuffed``."""
    return df.withColumn(into, F.arrow_udf(_judge, returnType=_RESULT)(F.col(f"`{text}`").cast("string")))
