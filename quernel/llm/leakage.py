"""Evaluation texts inside training texts (problem 7), found by Wu-Manber multi-pattern search.

Texts and test items are folded to the same byte string: look-alike letters become one letter, case, markup,
entities, layout, punctuation and invisible characters go. Each item is tiled with patterns of ``LENGTH``
bytes, one every ``STEP`` bytes, so that any run of LENGTH + STEP - 1 unchanged bytes holds a whole pattern.
Items of which ``least`` is shorter than such a run are tiled at every byte, with patterns no longer than that
share of any of them, in tables of their own.
The search reads the block of ``BLOCK`` bytes at the window's end: the shift table says how far no pattern can
end, the bucket of a block with shift 0 lists the patterns that end in it, and comparison confirms them.
Every confirmed occurrence is then widened over replaced words to the stretch of the item it belongs to; an
item has leaked into a text if one or two stretches in order hold at least ``least`` of the item.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quernel.session import bounded_rows, small

LENGTH, STEP, BLOCK = 24, 8, 7
#: Items that are searched for at once; more take a scan of the texts for each so many.
MOST_ITEMS = 200_000
#: After a mismatch the two sides may differ by so many bytes before they must agree over ``AGREE`` bytes again.
GAP, AGREE = 48, 9
COST, DROP = 1.5, 60.0

# Letters that look like a Latin letter.
_LOOK_ALIKES = str.maketrans(
    "аеорсухіјѕԁһԛԝґвкмнтзьαβγεικνορτυχωϲϳ",
    "aeopcyxijsdhqwrbkmht3babyeikvoptuxwcj",
)
_HAS_LOOK_ALIKE = re.compile("[Ͱ-ԯ]")
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>|<!--.*?-->", re.S)
_STRANGE = re.compile(r"[^\w\x00-\x7f]+")
_DROPPED = bytes(b for b in range(128) if not chr(b).isalnum())


def fold(text: str) -> bytes:
    """What is compared of a text: its letters and digits, without case, look of letters, markup and layout."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("", text)
    if not text.isascii():
        text = _STRANGE.sub("", unicodedata.normalize("NFKC", text))
    text = text.lower()
    if _HAS_LOOK_ALIKE.search(text):
        text = text.translate(_LOOK_ALIKES)
    return text.encode("utf-8", "ignore").translate(None, _DROPPED)


class _Patterns:
    """Wu-Manber tables: every item tiled with patterns of ``length`` bytes, one every ``step`` bytes."""

    def __init__(self, items: dict[int, bytes], length: int, step: int):
        self.length, self.far = length, length - BLOCK + 1
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, list[tuple[bytes, int, int]]] = defaultdict(list)
        for key, folded in items.items():
            starts = sorted({*range(0, len(folded) - length + 1, step), len(folded) - length})
            for start in starts:
                pattern = folded[start : start + length]
                for end in range(BLOCK, length + 1):
                    block = pattern[end - BLOCK : end]
                    self.shift[block] = min(self.shift.get(block, self.far), length - end)
                self.bucket[pattern[-BLOCK:]].append((pattern, key, start))

    def search(self, text: bytes, found: dict[int, list[tuple[int, int]]]) -> None:
        length, shift, far, end, stop = self.length, self.shift.get, self.far, self.length, len(text)
        while end <= stop:
            block = text[end - BLOCK : end]
            by = shift(block, far)
            if by:
                end += by
                continue
            window = text[end - length : end]
            for pattern, key, start in self.bucket[block]:
                if pattern == window:
                    found.setdefault(key, []).append((end - length, start))
            end += 1


class LeakSearch:
    """The tables of the search over a bounded set of items, and the search itself."""

    def __init__(self, items: dict[int, str], least: float = 0.5):
        self.least = least
        self.items = {k: f for k, text in items.items() if text and (f := fold(text))}
        self.backward = {k: f[::-1] for k, f in self.items.items()}
        self.short = {k: f for k, f in self.items.items() if len(f) < LENGTH}
        # An item shorter than a pattern is searched for by its beginning, if it has the bytes of a block.
        begun = {k: f for k, f in self.short.items() if len(f) >= BLOCK}
        self.tiny = {k: f for k, f in self.short.items() if len(f) < BLOCK}
        self.beginnings = _Patterns({k: f[: min(map(len, begun.values()))] for k, f in begun.items()}, min(map(len, begun.values())), 1) if begun else None
        needed = {k: math.ceil(least * len(f)) for k, f in self.items.items() if k not in self.short}
        fine = {k: n for k, n in needed.items() if BLOCK <= n < LENGTH + STEP - 1}
        groups = [({k: self.items[k] for k in needed if k not in fine}, LENGTH, STEP), ({k: self.items[k] for k in fine}, min([LENGTH, *fine.values()]), 1)]
        self.tables = [_Patterns(*g) for g in groups if g[0]]
        self.size = {k: length for own, length, _ in groups for k in own}

    def occurrences(self, text: bytes) -> dict[int, list[tuple[int, int]]]:
        """Item -> (place in the text, place in the item) of every pattern that occurs in the folded text."""
        found: dict[int, list[tuple[int, int]]] = {}
        for table in self.tables:
            table.search(text, found)
        return found

    def leaked(self, raw: str | None) -> list[tuple[int, float]]:
        """(item, share of it that the text holds) for every item that has leaked into the text."""
        if not raw:
            return []
        text = fold(raw)
        out = [(key, 1.0) for key, item in self.tiny.items() if item in text]
        if self.beginnings:
            begun: dict[int, list[tuple[int, int]]] = {}
            self.beginnings.search(text, begun)
            out += [(key, 1.0) for key, places in begun.items() if any(text.startswith(self.short[key], at) for at, _ in places)]
        hits = self.occurrences(text)
        back = text[::-1] if hits else b""
        for key, places in hits.items():
            share = self._share(text, back, key, places)
            if share >= self.least:
                out.append((key, round(share, 4)))
        return sorted(out)

    def _share(self, text: bytes, back: bytes, key: int, hits: list[tuple[int, int]]) -> float:
        item, item_back, length = self.items[key], self.backward[key], self.size[key]
        stretches: list[tuple[int, int, int, int]] = []
        live: list[tuple[int, int, int, int]] = []
        for j, i in sorted(hits):
            live = [x for x in live if x[3] >= j + length]
            if any(a <= i and i + length <= b and c <= j for a, b, c, _ in live):
                continue
            b, d = _forward(item, text, i, j)
            a, c = _forward(item_back, back, len(item) - i, len(text) - j)
            stretches.append((len(item) - a, b, len(text) - c, d))
            live.append(stretches[-1])
        best, before = 0, set()
        for a2, b2, _, _ in sorted(stretches, key=lambda x: x[2]):
            best = max(best, b2 - a2)
            for a, b in before:
                if a < a2 and b < b2:  # in order; what both hold counts once
                    best = max(best, b - a + b2 - max(a2, b))
            before.add((a2, b2))
        return best / len(item)


def _forward(item: bytes, text: bytes, i: int, j: int) -> tuple[int, int]:
    """Where the stretch that goes through (i, j) ends in both.

    Matched bytes earn 1, passed-over bytes cost ``COST``; the stretch ends where it had earned most, and is
    given up ``DROP`` below that.
    """
    m, n = len(item), len(text)
    earned = most = 0.0
    best = (i, j)
    while True:
        step, from_i = 64, i
        while step:
            while i + step <= m and j + step <= n and item[i : i + step] == text[j : j + step]:
                i, j = i + step, j + step
            step //= 4
        earned += i - from_i
        if earned > most:
            most, best = earned, (i, j)
        for skip in range(min(GAP, m - i - AGREE + 1)):
            at = text.find(item[i + skip : i + skip + AGREE], j, j + GAP + AGREE)
            if at >= 0:
                earned -= COST * max(skip, at - j)
                i, j = i + skip, at
                break
        else:
            return best
        if earned < most - DROP:
            return best


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", least: float = 0.5) -> DataFrame:
    """(id_col, item_id, share): the items that leaked into each text, with the share of the item it holds.

    The texts are only scanned, with no shuffle, so a hot source is no concern; ``MOST_ITEMS`` items are searched for in
    one scan, and a larger set in several. Null and blank texts and items leak nothing. An item shorter
    than a pattern counts where a text holds it whole. Repeated items are found under each id.
    """
    wanted = items.select(F.col(item_id).alias("k"), F.col(item_text).alias("t")).where("t is not null and k is not null")
    blocks = max(1, -(-wanted.count() * 5 // (4 * MOST_ITEMS))) if wanted.limit(MOST_ITEMS + 1).count() > MOST_ITEMS else 1
    out = None
    for block in range(blocks):
        own = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("k"), F.lit(blocks)) == block)
        part = _leaks_of(docs, own, id_col, text_col, item_id, least)
        out = part if out is None else out.unionByName(part)
    return out


def _leaks_of(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id: str, least: float) -> DataFrame:
    """``leaks`` of a block of items (k, t)."""
    search = docs.sparkSession.sparkContext.broadcast(LeakSearch({r.k: r.t for r in bounded_rows(items, MOST_ITEMS, "a block of the items")}, least))

    @pandas_udf("array<struct<item:bigint,share:double>>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        leaked = search.value.leaked
        for texts in batches:
            yield texts.map(lambda t: [{"item": k, "share": s} for k, s in leaked(t)])

    hits = docs.select(id_col, F.explode(found(F.col(text_col))).alias("__hit"))
    return hits.select(id_col, F.col("__hit.item").alias(item_id), F.col("__hit.share").alias("share"))


def leak_report(found: DataFrame, docs: DataFrame, items: DataFrame) -> DataFrame:
    """(suite, source, n_docs, n_items): where the items of each suite leaked; documents keep their own source."""
    return (
        found.join(docs.select("doc_id", "source"), "doc_id")
        .join(small(items.select("item_id", "suite")), "item_id")
        .groupBy("suite", "source")
        .agg(F.countDistinct("doc_id").alias("n_docs"), F.countDistinct("item_id").alias("n_items"))
    )
