"""Sentence boundaries across languages and scripts (problem 8).

A text is cut into blocks at blank lines and before lines that begin with a list marker; a block's end is
always a sentence's end. Inside a block the candidates are

* in spaced scripts the terminators, all of which form a lattice: a path from the block's start to its end visits those
  that end sentences. A visit pays or earns what lies before the terminator says (abbreviations, ordinals,
  initials, ellipses), the arc that leaves it pays for what it opens with (lower case, the attribution of a
  quotation, a unit's or an ordinal's head), and an arc that leaves a quotation or bracket open pays for that.
  The cheapest path is the segmentation;
* in spaceless scripts the gaps (spaces in Thai, terminators and closing quotes in Chinese and Japanese).
  The stretches beside a gap are segmented by a lattice of dictionary words, and the gap is classified by the
  final particle before it and the opening word after it, or by the verb that closes an attribution.

Null and blank texts have no sentences. Positions count Unicode code points from 0.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# --- Fixed values: language data -----------------------------------------------------------------------

#: Abbreviations that never end a sentence unless the block ends.
ABBREVIATIONS = frozenset(
    """
    cf eq eqs fig figs thm lem prop sect sec ch no nos vs approx al e.g i.e mr mrs ms dr prof st vol pp ed eds
    gen col lt sgt capt rev hon resp viz dept univ
    z bzw ca nr d h s vgl bd abb tab u.a z.b d.h hr fr
    m mm mme mlle env p ex art c.-à-d av chap éd
    sr sra srta dra ej núm pág aprox p.ej
    т е т.е им ул стр рис см
    डॉ श्री د
    """.split()
)
#: Abbreviations that end a sentence only if a capital follows.
TRAILING = frozenset("ltd inc co corp jr usw ff ud uds г гг п т.п д т.д р руб".split())
#: Abbreviations that end a sentence unless a word of ``INSIDE`` follows.
CLOSING = frozenset("etc a.m p.m am pm".split())
INSIDE = frozenset(["sharp"])
#: Words after a German ordinal.
ORDINAL_HEADS = frozenset(
    "januar februar märz april mai juni juli august september oktober november dezember jahrhundert jahrhunderts"
    " jahrtausend tag woche monat auflage kapitel klasse stock etage".split()
)
#: Verbs that attribute a quotation which ends in its own ? or !.
ATTRIBUTING = frozenset(
    "asked said cried replied whispered muttered insisted repeated explained admitted shouted exclaimed wondered"
    " fragte sagte rief demanda dit cria dijo preguntó gritó exclamó сказал сказала спросил спросила".split()
)
#: Words that open an English sentence, used where a lower-cased text lost the space after a period.
OPENERS = frozenset(
    "the a an this that its our their each every some one another who what how let in by after at before as when"
    " meanwhile soon once last two years even for on is".split()
)
#: Thai: particles that close a sentence, words that go on with the one before the gap.
THAI_FINALS = frozenset("ค่ะ คะ ครับ นะ นะคะ นะครับ จ้ะ จ้า".split())
THAI_GOES_ON = frozenset(
    "จำนวน น้ำหนัก ราคา ประมาณ ยาว สูง กว้าง ชิ้น อัน ตัว คน เล่ม กก กิโลกรัม กรัม กม เมตร บาท และ แต่ หรือ ซึ่ง เพราะ จึง โดย ที่".split()
)
#: Chinese and Japanese words that attribute the quotation before them.
HAN_ATTRIBUTING = ("喊道", "说道", "问道", "答道", "叫道", "笑道", "说", "问")
KANA_GOES_ON = ("と", "って", "という")

# --------------------------------------------------------------------------------------------------------

_EMOJI = "[\U0001f300-\U0001faff☀-➿]️?"
_CLOSE = "(?:[   ]?[»›]|​*[\"”“’'\\)\\]」』）】》])*"
_CANDIDATE = re.compile(f"[.!?…。！？｡।॥؟۔]+{_CLOSE}(?:\\s*{_EMOJI})*|(?:\\s*{_EMOJI})+")
_BLANK_LINE = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
_MARKED_LINE = re.compile(r"\n(?=[^\S\n]*(?:[-*•‣◦·]|\(?\d{1,3}[.)]|\(?[a-z]\))[^\S\n]+\S)")
_WORD_BEFORE = re.compile(r"(?:[^\W_]|[.\-'’̀-ͯऀ-ॣ])*[^\W_][ऀ-ःऺ-ॏ]*$")
_NEXT = re.compile("[\\s\"'“”„«»‘’¿¡(\\[—–​-]*")
_WORD = re.compile(r"[^\W\d_]+")
_WIDE = frozenset("。！？｡")
_THAI = re.compile("[฀-๿]")
_THAI_GAP = re.compile(r"\s+")
_THAI_STRETCH = re.compile(r"\S*")
_STRETCH = re.compile(r"[^。！？，、：；“”「」『』\n]+")
_EMOJI_HERE = re.compile(_EMOJI)
_OPENING, _PAIRED = frozenset("“„«「『（("), re.compile("[“”„«»「」『』（）()]")
_LONGEST_LISTED = 2 + max(map(len, ABBREVIATIONS | TRAILING | CLOSING))

#: What a visit costs: a terminator that ends sentences earns, an abbreviation or a pause costs.
ENDS, ABBREVIATES, PAUSES = -2.0, 2.0, 2.0
#: What an arc costs that opens with words that go on with the sentence before, or that leaves a quotation or bracket open.
GOES_ON, LEFT_OPEN = 4.0, 2.5

#: Where a sentence would end, the cost of the visit, and of the opening behind it.
Node = tuple[int, float, float]


class WordLattice:
    """Splits spaceless text into dictionary words: the path of fewest words, unknown characters costing more.

    The dictionary is a trie, so a place of the text costs as many steps as its longest word has characters.
    """

    def __init__(self, words: Iterable[str], unknown: float = 1.6):
        self.unknown = unknown
        self.trie: dict = {}
        for word in filter(None, words):
            node = self.trie
            for c in word:
                node = node.setdefault(c, {})
            node[""] = True

    def split(self, text: str) -> list[str]:
        n = len(text)
        cost, begun = [0.0] + [math.inf] * n, [0] * (n + 1)
        for begin in range(n):
            here = cost[begin]
            if here + self.unknown < cost[begin + 1]:
                cost[begin + 1], begun[begin + 1] = here + self.unknown, begin
            node, at = self.trie, begin
            while at < n and (node := node.get(text[at])) is not None:
                at += 1
                # Of paths that cost the same, the one whose last word begins first.
                if "" in node and here + 1 < cost[at]:
                    cost[at], begun[at] = here + 1, begin
        out = []
        while n:
            out.append(text[begun[n] : n])
            n = begun[n]
        return out[::-1]


class Splitter:
    """Finds the sentence ends of a text. ``words`` extend the lattice of the spaceless scripts."""

    def __init__(self, words: Iterable[str] = ()):
        spaceless = (w.strip() for w in words)
        thai, wide = set(), set()
        for w in spaceless:
            (thai if _THAI.match(w) else wide).add(w)
        self.thai = WordLattice(thai | THAI_FINALS | THAI_GOES_ON)
        self.wide = WordLattice(wide | {*HAN_ATTRIBUTING, *KANA_GOES_ON})
        self._quotes = (-1, 0, 0)

    def ends(self, text: str | None) -> list[int]:
        if not text or text.isspace():
            return []
        lowered = text == text.lower()
        found: list[int] = []
        self._quotes = (-1, 0, 0)
        start = 0
        for blank in _BLANK_LINE.finditer(text):
            self._lines(text, start, blank.start(), lowered, found)
            start = blank.end()
        self._lines(text, start, len(text), lowered, found)
        return found

    def _lines(self, text: str, start: int, stop: int, lowered: bool, found: list[int]) -> None:
        for line in _MARKED_LINE.finditer(text, start, stop):
            self._block(text, start, line.start(), lowered, found)
            start = line.end()
        self._block(text, start, stop, lowered, found)

    def _block(self, text: str, start: int, stop: int, lowered: bool, found: list[int]) -> None:
        while stop > start and (text[stop - 1].isspace() or text[stop - 1] in "​﻿"):
            stop -= 1
        while start < stop and text[start].isspace():
            start += 1
        if start == stop:
            return
        if _THAI.search(text, start, stop):
            found.extend(self._thai(text, start, stop))
        else:
            self._terminators(text, start, stop, lowered, found)
        found.append(stop)

    # Spaced scripts, and the wide terminators of Chinese and Japanese

    def _terminators(self, text: str, start: int, stop: int, lowered: bool, found: list[int]) -> None:
        nodes: list[Node] = []
        for m in _CANDIDATE.finditer(text, start, stop):
            end = m.end()
            if end >= stop:
                break
            node = self._wide(text, m.start(), end, stop) if text[m.start()] in _WIDE else self._narrow(text, start, m.start(), end, stop, lowered)
            if node is not None:
                nodes.append(node)
        if nodes:
            found.extend(_cheapest(text, start, stop, nodes))

    def _wide(self, text: str, at: int, end: int, stop: int) -> Node | None:
        """A wide terminator, and what opens after it: words that go on with a closed quotation cost."""
        if text[end - 1] == "“":  # it opens the next quotation here
            end -= 1
        if text[end] in "，、；：，,;)）]】":
            return None
        opening = 0.0
        if text[end - 1] in "”」』":
            stretch = _STRETCH.match(text, end, stop)
            if stretch:
                words = self.wide.split(stretch.group())
                closing = text[stretch.end() : stretch.end() + 1] in ("。", "，", "！", "")
                if words[0] in KANA_GOES_ON or closing and words[-1] in HAN_ATTRIBUTING:
                    opening = GOES_ON
        return end, ENDS, opening

    def _narrow(self, text: str, start: int, at: int, end: int, stop: int, lowered: bool) -> Node | None:
        """A terminator of spaced scripts: where a sentence would end once closing quotes are told apart, what that
        earns, and what the words behind cost as a sentence's opening. None where nothing can open."""
        bare = at
        while bare < end and text[bare] in ".!?…।॥؟۔":
            bare += 1
        mark = text[at:bare]
        if not text[end].isspace() and end > bare:  # no space behind: a quote may open the next sentence
            last = text[end - 1]
            if last == "“" or last == '"' and self._even_quotes(text, start, end - 1):
                end -= 1
        glued = not text[end].isspace()
        to = _NEXT.match(text, end, stop).end()
        if to >= stop or text[end] in ",;:":
            return None
        head = text[to]
        opening = GOES_ON if head.islower() and not lowered else 0.0
        if not mark:  # an emoji stands for the terminator
            return end, ENDS, opening
        word = _WORD.match(text, to, stop)
        following = word.group() if word else ""
        low_following = following.lower()
        if glued:
            if mark not in (".", "!", "?", "....", "।", "؟", "...", "…") or not head.isalpha() and head not in "$\\":
                return None
            if lowered and head.lower() != head.upper() and (following not in OPENERS or len(_token(text, start, at)) < 2 or text[to + len(following) : to + len(following) + 1] in "./"):
                return None
        elif end > bare and mark[-1] in "?!" and text[end - 1] in "\"”»“" and attributed(text, to, stop, following):
            opening = GOES_ON
        if mark in ("...", "…") and (at == start or text[at - 1].isspace()):
            return end, PAUSES, opening  # four dots end the sentence
        if mark == "." and end == bare:
            before = _token(text, start, at)
            low = before.lower()
            if low in CLOSING:
                return end, ENDS, GOES_ON if low_following in INSIDE else opening
            if low in ABBREVIATIONS:
                return end, ABBREVIATES, opening
            if low in TRAILING:
                return end, ENDS, opening if head.isupper() else GOES_ON
            if len(before) == 1 and before.isalpha() and (before.isupper() or lowered):
                return end, ABBREVIATES, opening  # an initial
            if low_following in ORDINAL_HEADS and before.isdigit():
                opening = GOES_ON
        return end, ENDS, opening

    def _even_quotes(self, text: str, start: int, end: int) -> bool:
        """Whether an even number of straight quotes lies between a block's start and ``end``; asked left to right."""
        block, at, count = self._quotes
        if block != start or at > end:
            at, count = start, 0
        count += text.count('"', at, end)
        self._quotes = (start, end, count)
        return count % 2 == 0

    # Thai

    def _thai(self, text: str, start: int, stop: int) -> list[int]:
        ends = []
        signs, counted = 0, start
        final, at = "", start  # the last word before the gap at hand, and where its stretch begins
        for gap in _THAI_GAP.finditer(text, start, stop):
            left, right = gap.start(), gap.end()
            signs, counted = signs + text.count("$", counted, left), left
            stretch = text[at:left]
            at = right
            if signs % 2 or text[right] in "$\\,)" or text[left - 1] in "$,(" or text[right].isdigit() or _EMOJI_HERE.match(text, right):
                continue
            final = self.thai.split(stretch)[-1] if _THAI.match(text[left - 1]) else ""
            if final not in THAI_FINALS:
                behind = _THAI_STRETCH.match(text, right, stop).group()
                opening = self.thai.split(behind)[0] if behind else ""
                if opening.rstrip(".") in THAI_GOES_ON:
                    continue
                if text[left - 1] == "." and left - start > 1 and _token(text, start, left - 1).lower() in ABBREVIATIONS:
                    continue
                if _bare_number(text, start, left):
                    continue
            ends.append(left)
        return ends


def _bare_number(text: str, start: int, left: int) -> bool:
    """Whether the gap at ``left`` follows a number that still waits for its unit."""
    at = left
    while at > start and (text[at - 1].isdigit() or text[at - 1] in ".,"):
        at -= 1
    return at < left and (at == start or text[at - 1].isspace()) and text[left - 1].isdigit()


def _token(text: str, start: int, at: int) -> str:
    """The word that ends at ``at``, with periods and hyphens inside it; a longer one than any that is listed is cut."""
    m = _WORD_BEFORE.search(text, max(start, at - _LONGEST_LISTED), at)
    return m.group().lstrip(".-'’") if m else ""


def attributed(text: str, to: int, stop: int, following: str) -> bool:
    """Whether the words behind a quotation attribute it: a verb, or a name and its verb, but no new speech."""
    if following.lower() in ATTRIBUTING:
        return True
    second = _WORD.match(text, min(stop, to + len(following) + 1), stop)
    if not following or not second or second.group().lower() not in ATTRIBUTING:
        return False
    rest = text[second.end() : second.end() + 6]
    return not (rest.startswith(",") or rest.startswith(" that"))


def _cheapest(text: str, start: int, stop: int, nodes: list[Node]) -> list[int]:
    """The ends on the cheapest path from ``start`` to ``stop`` through the lattice of terminators.

    An arc pays for its opening, and for each quotation or bracket that it leaves open more than it found; so it
    matters only between which depths an arc leads, and the cheapest way to every depth is enough to go on from.
    """
    depth, at, state, low = [], start, 0, 0
    for end in [*(n[0] for n in nodes), stop]:
        for c in _PAIRED.findall(text, at, end):
            if c == "“" and low:  # it closes what „ opened
                low, state = low - 1, state - 1
            else:
                low += c == "„"
                state += 1 if c in _OPENING else -1
        depth.append(state)
        at = end
    if not any(depth):
        return [end for end, visit, opening in nodes if visit + opening < 0]
    reached: dict[int, tuple[float, int]] = {0: (0.0, -1)}  # the cheapest opening at each depth, and its node
    back = []
    for j, d in enumerate(depth):
        cost, i = min((c + (LEFT_OPEN if d > e else 0.0), i) for e, (c, i) in reached.items())
        back.append(i)
        if j < len(nodes):
            cost += nodes[j][1] + nodes[j][2]
            if d not in reached or cost < reached[d][0]:
                reached[d] = cost, j
    ends, i = [], back[-1]
    while i >= 0:
        ends.append(nodes[i][0])
        i = back[i]
    return ends[::-1]


def sentence_ends(words: Iterable[str] = ()):
    """A function Column -> Column: the sentence ends of a text, ascending. ``words`` extend the word lattice."""
    words = tuple(words)

    @pandas_udf("array<int>")
    def ends(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        splitter = Splitter(words)
        for texts in batches:
            yield texts.map(splitter.ends)

    return ends


def sentence_texts(words: Iterable[str] = ()):
    """A function Column -> Column: the sentences of a text in order, without the white space between them."""
    words = tuple(words)

    @pandas_udf("array<string>")
    def texts_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        splitter = Splitter(words)

        def cut(text: str | None) -> list[str]:
            ends = splitter.ends(text)
            return [text[a:b].strip() for a, b in zip([0, *ends], ends)]

        for texts in batches:
            yield texts.map(cut)

    return texts_of


def _prose(docs: DataFrame, domain_col: str, code_domain: str) -> Column:
    return F.coalesce(F.col(domain_col) != code_domain, F.lit(True)) & F.col("text").isNotNull()


def prose_sentence_ends(docs: DataFrame, words: Iterable[str] = (), domain_col: str = "domain", code_domain: str = "code") -> DataFrame:
    """(doc_id, sent_end): one row per sentence of every document outside ``code_domain``; no shuffle."""
    kept = docs.where(_prose(docs, domain_col, code_domain)).select("doc_id", "text")
    return kept.select("doc_id", F.explode(sentence_ends(words)("text")).alias("sent_end"))


def prose_sentences(docs: DataFrame, words: Iterable[str] = (), domain_col: str = "domain", code_domain: str = "code") -> DataFrame:
    """(doc_id, sent_no, sentence): the sentences of every document outside ``code_domain`` in order."""
    kept = docs.where(_prose(docs, domain_col, code_domain)).select("doc_id", "text")
    return kept.select("doc_id", F.posexplode(sentence_texts(words)("text")).alias("sent_no", "sentence"))
