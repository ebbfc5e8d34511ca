"""The subject areas of each text (problem 1).

Rows become normalised tf-idf vectors, which bisecting k-means splits into leaves, a tree per language. Every unit
(sentence or line) of a row is then placed in the leaf whose terms fit it best, the leaves' terms are counted again over
the units placed in them, and a leaf is labelled with the subject whose labelled rows share its discriminative
terms. A row's mixture of leaves, unit by unit, gives its subjects: those whose leaves hold at least ``LEAST_SHARE``
of its units. Hand labels name leaves; no unit is assigned but by a leaf.

Terms are hashed to ``DIMENSIONS`` places within their language, so every term of every row counts and the model's
size doesn't depend on the rows: at most 2 ** ``LEVELS`` leaves x ``DIMENSIONS`` numbers a language, for
``LANGUAGES_AT_ONCE`` languages at a time. A pass over the rows sends one sparse vector per tree node
and partition through the shuffle, and their sums to the driver. Sums are of integers, so neither the partitions nor
the order in which they are added change a result.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quernel.llm.sentences import ABBREVIATIONS, ORDINAL_HEADS, attributed
from quernel.session import bounded_rows, checkpointed

LEVELS, DIMENSIONS, SEED = 6, 1 << 13, 11
#: A node is split only into parts of so many rows each.
LEAST_LEAF = 4
LEAST_SHARE = 0.2
#: Weight that a unit's terms must have for a leaf; a unit below it is of no leaf, thus general.
LEAST_SCORE = 1.8
#: A term is discriminative where it is so many times as frequent as elsewhere: in a leaf, in a subject's labelled rows.
LEAF_LIFT, SUBJECT_LIFT = 2.0, 2.0
#: Terms of the average class that smooth a class's shares.
SMOOTH = 100.0
#: Terms that a subject's leaves together lend to each of its leaves.
LENT = 1000.0
MOST_SUBJECTS, MOST_LANGUAGES, LANGUAGES_AT_ONCE = 10_000, 10_000, 16
#: Weights are added up in units of this.
UNIT = 1 << 15

_TAG = re.compile(r"<\|[^|<>]*\|>|</?[a-z]+(?::\w+)?/?>", re.I)
_TERM = re.compile(r"[^\W\d_]{2,}|[^\w\s,.'\"“”«»„!?;:()’–—-]")
_BREAK = re.compile(
    r"\n[^\S\n]*\n\s*|\n(?=[^\S\n]*(?:[-*•]|\d{1,3}[.)])[^\S\n])|([.!?…]+)([\"”“»’)\]]*(?:[ \xa0]»)?)\s+(?=[^a-zß-öø-ÿ,;:\s])"
)
_WORD = re.compile(r"[^\W\d_]+")
_OPENING = re.compile(r"[\W_]*")


def clean(text: str) -> str:
    """A text without control tags and entities."""
    return _TAG.sub("\n", html.unescape(text) if "&" in text else text)


def units(text: str) -> list[str]:
    """The sentences of a text and the lines of its listings.

    Cheaper than the sentence operator and coarser: what tells subjects apart is a unit's words, so single words
    stay with the unit behind them.
    """
    text = clean(text)
    out: list[str] = []
    start = 0
    for m in _BREAK.finditer(text):
        if m.group(1) is not None and not _ends(text, start, m):
            continue
        _add(out, text[start : m.end()])
        start = m.end()
    _add(out, text[start:])
    return out


def _ends(text: str, start: int, m: re.Match) -> bool:
    """Whether a terminator ends a unit."""
    at = m.start()
    before = text.rfind(" ", start, at) + 1
    if before <= start:
        return False
    if m.group(2):
        if m.group(1)[-1] == ".":
            return True
        to = _OPENING.match(text, m.end()).end()
        word = _WORD.match(text, to)
        return not attributed(text, to, len(text), word.group() if word else "")
    if m.group(1) != ".":
        return True
    word = text[before:at].lstrip("(\"“„«").lower()
    if word in ABBREVIATIONS or len(word) == 1 and word.isalpha():
        return False
    following = _WORD.match(text, m.end())
    return not (word.isdigit() and following and following.group().lower() in ORDINAL_HEADS)


def _add(out: list[str], piece: str) -> None:
    piece = piece.strip()
    if "\n" in piece:
        lines = [x for y in piece.split("\n") if (x := y.strip())]
        if len(lines) > 1 and not _wrapped(lines):
            out += lines
        else:
            out.append(" ".join(lines))
    elif piece:
        out.append(piece)


def _wrapped(lines: list[str]) -> bool:
    """Whether lines are one sentence wrapped, rather than a listing: running words, and only the last may stop."""
    letters = sum(c.isalpha() or c == " " for x in lines for c in x)
    return letters > 0.9 * sum(map(len, lines)) and all(len(x.split()) > 2 for x in lines[:-1])


def terms(unit: str) -> list[str]:
    """Lower-cased words and signs. Numbers are left out: tables of any subject share them."""
    return _TERM.findall(unit.lower())


class _Places(dict):
    """The place of each term, remembered while a process runs."""

    def __missing__(self, term: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        at = self[term] = zlib.crc32(term.encode("utf-8", "surrogatepass")) % DIMENSIONS
        return at


_place = _Places()

# What Python sees of the rows: lists of places. ``words`` has a row's distinct ones; ``terms`` those of its units, one
# unit after the other, ``sizes`` how many each unit has (none for a unit without terms).


def _looked_at(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        words, flat, sizes = [], [], []
        for text in texts:
            places = [{_place[t] for t in terms(u)} for u in units(text)]
            words.append(np.fromiter(set().union(*places), np.int16))
            flat.append(np.fromiter((t for p in places for t in p), np.int16))
            sizes.append(np.fromiter(map(len, places), np.int16))
        yield pd.DataFrame({"words": words, "terms": flat, "sizes": sizes})


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list column as its values and each list's length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _dot(weights: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(at, weights=weights, minlength=n)


class Rows:
    """A batch of rows: their languages (places in ``known``), words and weights. Rows of other languages are left out."""

    def __init__(self, batch: pa.RecordBatch, model: Model):
        of = {x: i for i, x in enumerate(model.languages)}
        stated = np.array([of.get(x, -2) if x is not None else -1 for x in batch["lang"].to_pylist()], np.int64)
        self.words, lengths = _lists(batch["words"])
        self.row = np.repeat(np.arange(len(lengths)), lengths)
        missing = np.flatnonzero(stated == -1)
        if len(missing):
            stated[missing] = model.guessed(self.words, self.row, missing, len(lengths))
        # From language to its place among those at hand, -1 for the others.
        self.language = np.where(stated >= 0, model.at_hand[stated], -1)
        self.kept = self.language >= 0
        inside = self.kept[self.row]
        self.words, self.row, self.n = self.words[inside], self.row[inside], len(lengths)

    def weighted(self, model: Model) -> np.ndarray:
        """tf-idf weights of the words, each row's vector of length 1, in whole numbers of ``1 / UNIT``."""
        w = model.rarity[self.language[self.row], self.words].astype(np.float64)
        norm = np.sqrt(_dot(w * w, self.row, self.n))
        return np.rint(w / np.maximum(norm, 1e-9)[self.row] * UNIT)


class Model:
    """Languages, rarities and the tree, as passes need them. ``languages`` are all that rows state."""

    def __init__(self, languages: list[str]):
        self.languages = languages
        self.likely = np.zeros((len(languages), DIMENSIONS), np.float32)
        self.choose(np.arange(len(languages)))
        self.rarity = np.zeros((len(languages), DIMENSIONS), np.float32)

    def choose(self, languages: np.ndarray) -> None:
        """Starts a tree over these languages."""
        self.at_hand = np.full(len(self.languages), -1)
        self.at_hand[languages] = np.arange(len(languages))
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # (direction of each node, its two children)
        self.directions: np.ndarray | None = None  # of the level at work
        self.means: np.ndarray | None = None
        self.leaf_weights: list[np.ndarray] = []  # terms x leaves of each language
        self.leaves: list[np.ndarray] = []

    def guessed(self, words: np.ndarray, row: np.ndarray, which: np.ndarray, n: int) -> np.ndarray:
        """The likeliest language of each of the rows, by how many rows of each language hold its words."""
        fit = np.stack([_dot(x[words], row, n)[which] for x in self.likely])
        return fit.argmax(0)

    def node(self, rows: Rows, w: np.ndarray) -> np.ndarray:
        """The node that each row has come to."""
        node = np.maximum(rows.language, 0)
        for directions, children in self.levels:
            side = _dot(w * directions[node[rows.row], rows.words], rows.row, rows.n) > 0
            node = children[node, side.astype(np.int64)]
        return node

    def side(self, rows: Rows, w: np.ndarray, node: np.ndarray) -> np.ndarray:
        s = _dot(w * self.directions[node[rows.row], rows.words], rows.row, rows.n)
        return (s > (self.means[node] if self.means is not None else 0)).astype(np.int64)

    def placed(self, batch: pa.RecordBatch, rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(terms, unit of each term, row of each unit, leaf of each unit or -1, whether the unit's row is at hand)."""
        flat, _ = _lists(batch["terms"])
        sizes, counts = _lists(batch["sizes"])
        row = np.repeat(np.arange(len(counts)), counts)
        unit = np.repeat(np.arange(len(sizes)), sizes)
        leaf = np.full(len(sizes), -1)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        full = np.flatnonzero(sizes > 0)
        for language, (weights, leaves) in enumerate(zip(self.leaf_weights, self.leaves)):
            own = full[rows.language[row[full]] == language]
            for part in np.array_split(own, max(1, len(own) // 4096)):
                if len(part):
                    at = np.concatenate([[0], np.cumsum(sizes[part])])
                    picked = np.arange(at[-1]) + np.repeat(starts[part] - at[:-1], sizes[part])
                    score = np.add.reduceat(weights[flat[picked]], at[:-1], axis=0)
                    leaf[part] = np.where(score.max(1) >= LEAST_SCORE, leaves[score.argmax(1)], -1)
        return flat, unit, row, leaf, rows.kept[row]


Counted = Callable[["Model", pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _row_counts(model: Model, batch: pa.RecordBatch):
    """Rows of each language that hold each word, before languages are guessed."""
    of = {x: i for i, x in enumerate(model.languages)}
    language = np.array([of.get(x, -1) if x is not None else -1 for x in batch["lang"].to_pylist()], np.int64)
    words, lengths = _lists(batch["words"])
    key = np.repeat(language, lengths)
    return key[key >= 0], words[key >= 0], None, np.bincount(language[language >= 0], minlength=1)


def _held_counts(model: Model, batch: pa.RecordBatch):
    """Rows of each language at hand that hold each word."""
    rows = Rows(batch, model)
    return rows.language[rows.row], rows.words, None, np.bincount(rows.language[rows.kept], minlength=1)


def _root_sums(model: Model, batch: pa.RecordBatch):
    """The rows' vectors added up by node."""
    rows = Rows(batch, model)
    w = rows.weighted(model)
    node = model.node(rows, w)
    return node[rows.row], rows.words, w, np.bincount(node[rows.kept], minlength=1)


def _side_sums(model: Model, batch: pa.RecordBatch):
    """The rows' vectors added up by node and side."""
    rows = Rows(batch, model)
    w = rows.weighted(model)
    node = model.node(rows, w)
    key = node * 2 + model.side(rows, w, node)
    return key[rows.row], rows.words, w, np.bincount(key[rows.kept], minlength=1)


def _leaf_counts(model: Model, batch: pa.RecordBatch):
    """Units that hold each term by leaf: the leaf of the unit, or its row's before units are placed."""
    rows = Rows(batch, model)
    if model.leaf_weights:
        flat, unit, _, leaf, kept = model.placed(batch, rows)
    else:
        flat, _ = _lists(batch["terms"])
        sizes, counts = _lists(batch["sizes"])
        unit = np.repeat(np.arange(len(sizes)), sizes)
        row = np.repeat(np.arange(len(counts)), counts)
        leaf, kept = model.node(rows, rows.weighted(model))[row], rows.kept[row]
    leaf = np.where(kept, leaf, -1)
    inside = leaf[unit] >= 0
    return leaf[unit][inside], flat[inside], None, np.bincount(leaf[leaf >= 0], minlength=1)


_SUMS = "key int, n long, places binary, sums binary"


def _summed(rows: DataFrame, model: Model, counted: Counted, keys: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys x DIMENSIONS sums, rows of each key): what ``counted`` finds in the batches, added up over all rows."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def packed(sums: np.ndarray, n: np.ndarray, keys_of: np.ndarray) -> pa.RecordBatch:
        places = [np.flatnonzero(x) for x in sums]
        return pa.RecordBatch.from_pydict({
            "key": pa.array(keys_of, pa.int32()), "n": pa.array(n, pa.int64()),
            "places": pa.array([p.astype(np.int16).tobytes() for p in places], pa.binary()), "sums": pa.array([x[p].astype(np.int64).tobytes() for x, p in zip(sums, places)], pa.binary()),
        })

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows_of = np.zeros(keys * DIMENSIONS), np.zeros(keys, np.int64)
        for batch in batches:
            key, place, weight, n = counted(shared.value, batch)
            total += np.bincount(key * DIMENSIONS + place, weights=weight, minlength=keys * DIMENSIONS)
            rows_of[: len(n)] += n
        held = np.flatnonzero(rows_of)
        if len(held):
            yield packed(total.reshape(keys, DIMENSIONS)[held], rows_of[held], held)

    def added(table: pa.Table) -> pa.Table:
        total = np.zeros(DIMENSIONS, np.int64)
        for p, s in zip(table["places"].to_pylist(), table["sums"].to_pylist()):
            total[np.frombuffer(p, np.int16)] += np.frombuffer(s, np.int64)
        n = sum(table["n"].to_pylist())
        return pa.Table.from_batches([packed(total[None], np.array([n]), np.array([table["key"][0].as_py()]))])

    got = rows.mapInArrow(partial, _SUMS).groupBy("key").applyInArrow(added, _SUMS).toArrow()
    sums, n = np.zeros((keys, DIMENSIONS)), np.zeros(keys, np.int64)
    for key, rows_of, p, s in zip(*(got[c].to_pylist() for c in ("key", "n", "places", "sums"))):
        n[key] = rows_of
        sums[key, np.frombuffer(p, np.int16)] = np.frombuffer(s, np.int64)
    shared.unpersist()
    return sums, n


def _grow(rows: DataFrame, model: Model, languages: int) -> np.ndarray:
    """Splits the model's nodes ``LEVELS`` times and gives each leaf's language.

    A node's rows are first parted by a random direction about their mean, then by the nearer of the parts' two
    centres (cosine), once more with the centres of those parts: three looks, two passes over the rows.
    """
    language = np.arange(languages)
    sums, n = _summed(rows, model, _root_sums, languages)
    for level in range(LEVELS):
        if not (n >= 2 * LEAST_LEAF).any():
            break
        nodes = len(language)
        signs = np.where(np.random.default_rng(SEED + level).integers(0, 2, DIMENSIONS) > 0, 1.0, -1.0)
        model.directions = np.broadcast_to(signs.astype(np.float32), (nodes, DIMENSIONS))
        model.means = sums @ signs / np.maximum(n, 1)
        for _ in range(2):
            parts, n = _summed(rows, model, _side_sums, 2 * nodes)
            centres = parts.reshape(nodes, 2, DIMENSIONS)
            centres = centres / np.maximum(np.linalg.norm(centres, axis=2, keepdims=True), 1e-9)
            model.directions, model.means = (centres[:, 1] - centres[:, 0]).astype(np.float32), None
        # The sides' rows as of the last pass say whether a node is worth splitting.
        n = n.reshape(nodes, 2)
        divided = n.min(1) >= LEAST_LEAF
        children = np.zeros((nodes, 2), np.int64)
        into = np.repeat(np.arange(nodes), np.where(divided, 2, 1))
        first = np.searchsorted(into, np.arange(nodes))
        children[:, 0], children[:, 1] = first, first + divided
        model.levels.append((model.directions, children))
        both = parts.reshape(nodes, 2, DIMENSIONS)
        sums = np.concatenate([both[i] if divided[i] else both[i].sum(0, keepdims=True) for i in range(nodes)])
        n = np.concatenate([n[i] if divided[i] else n[i : i + 1].sum(1) for i in range(nodes)])
        language = language[into]
    model.directions = model.means = None
    return language


def _fit_weights(counts: np.ndarray, rivals: np.ndarray | None = None, shares: np.ndarray | None = None) -> np.ndarray:
    """Weights (terms x leaves) of a language's leaves (leaves x terms).

    A term weighs the log of how many times as frequent it is in the leaf as in the language, or as in the strongest
    rival (``rivals``, a share per leaf and term) once labels tell rivals from allies; ``shares`` are the allies'.
    """
    total = counts.sum(0)
    common = total / max(1.0, total.sum())
    prior, lent = (common, 10.0) if shares is None else (shares, LENT)
    share = (counts + lent * prior) / (counts.sum(1, keepdims=True) + lent)
    weights = np.clip(np.log(np.maximum(share, 1e-12) / np.maximum(common if rivals is None else rivals, 1e-12)), 0, 4) * (total / (total + 3))
    return np.ascontiguousarray(weights.T, np.float32)


def _profiles(counts: np.ndarray, least: float) -> np.ndarray:
    """The discriminative terms of each row of ``counts`` (classes x terms), as vectors of length 1."""
    overall = np.maximum(counts.sum(0), 1e-9) / max(1.0, counts.sum())  # a term that none holds lifts none
    size = counts.sum(1, keepdims=True)
    share = (counts + SMOOTH * overall) / (size + SMOOTH)
    elsewhere = (counts.sum(0) - counts + SMOOTH * overall) / (counts.sum() - size + SMOOTH)
    lift = share / elsewhere
    p = np.where(lift > least, np.log(np.maximum(lift, 1)), 0.0) * np.sqrt(counts)
    return p / np.maximum(1e-9, np.linalg.norm(p, axis=1, keepdims=True))


def label_leaves(leaf_counts: np.ndarray, subject_counts: np.ndarray, otherwise: int) -> np.ndarray:
    """For each leaf (leaves x terms) the subject (subjects x terms) whose discriminative terms are its own."""
    fit = _profiles(leaf_counts, LEAF_LIFT) @ _profiles(subject_counts, SUBJECT_LIFT).T
    return np.where(fit.max(1) > 0, fit.argmax(1), otherwise)


def _against_rivals(counts: np.ndarray, labels: np.ndarray, subjects: int) -> np.ndarray:
    """Weights of a language's leaves against the strongest subject other than the leaf's own."""
    by_subject = np.zeros((subjects, counts.shape[1]))
    np.add.at(by_subject, labels, counts)
    size, seen = by_subject.sum(1, keepdims=True), np.count_nonzero(by_subject.sum(0))
    share = np.where(size > 0, (by_subject + 0.05) / np.maximum(size + 0.05 * seen, 1e-9), 0.0)
    order = np.sort(np.vstack([share, np.zeros((1, counts.shape[1]))]), 0)
    rivals = np.where(share == order[-1], order[-2], order[-1])
    # A language with one subject has no rival; its common terms then stand for one.
    alone = (size > 0).sum() < 2
    return _fit_weights(counts, None if alone else rivals[labels], share[labels])


def assigned_subjects(texts: DataFrame, areas: DataFrame, labels: DataFrame, general: str = "general") -> DataFrame:
    """(row_id, subject, share): each row's subjects with the share of its units.

    ``texts`` has row_id, lang and text, ``areas`` the subjects, ``labels`` (row_id, subject) for some rows. Rows with
    null or blank text have no subjects; a row whose units are of no subject often enough is ``general``. A row
    without a language counts as of the likeliest one that other rows state, and all are of one language if none does.
    Labels of unknown rows or subjects are ignored, and a few wrong ones are outvoted. A leaf that shares no
    discriminative term with a labelled row is ``general``, so a subject without labels in a language isn't found there.
    """
    subjects = sorted({r.subject for r in bounded_rows(areas.select("subject").where("subject is not null"), MOST_SUBJECTS, "the subjects")} | {general})
    other = subjects.index(general)
    looked_at = pandas_udf(_looked_at, "struct<words:array<smallint>,terms:array<smallint>,sizes:array<smallint>>")
    kept = texts.where("text is not null and trim(translate(text, '\n\t\r', '')) <> ''").select("row_id", "lang", looked_at("text").alias("l"))
    base = checkpointed(kept.select("row_id", "lang", "l.words", "l.terms", "l.sizes").where(F.size("sizes") > 0))
    languages = sorted(r.lang for r in bounded_rows(base.select("lang").distinct().where("lang is not null"), MOST_LANGUAGES, "the languages"))
    if not languages:
        languages = ["und"]
        base = base.withColumn("lang", F.lit("und"))
    rows, with_units = base.select("lang", "words"), base.select("lang", "words", "terms", "sizes")
    marked = labels.where(F.col("subject").isin(subjects)).select("row_id", F.col("subject").alias("__subject")).distinct()
    labelled = base.select("row_id", "lang", "words").join(marked, "row_id").select("lang", "words", "__subject")

    model = Model(languages)
    held, n = _summed(rows, model, _row_counts, len(languages))
    model.likely = np.log((held + 0.5) / (n[:, None] + 1)).astype(np.float32)
    # Rows without a language belong nowhere until it is guessed, so rarity is counted with the guesses.
    held, n = _summed(rows, model, _held_counts, len(languages))

    parts = []
    for first in range(0, len(languages), LANGUAGES_AT_ONCE):
        group = np.arange(first, min(first + LANGUAGES_AT_ONCE, len(languages)))
        parts.append(_mixtures(base, rows, with_units, labelled, model, group, held[group], n[group], subjects, other))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def _mixtures(base, rows, with_units, labelled, model: Model, group: np.ndarray, held: np.ndarray, n: np.ndarray, subjects: list[str], other: int) -> DataFrame:
    """``assigned_subjects`` of the rows of a group of languages."""
    model.choose(group)
    model.rarity = np.where(held >= 2, np.log(np.maximum(n, 1)[:, None] / np.maximum(held, 1)), 0.0).astype(np.float32)
    language = _grow(rows, model, len(group))
    counts, _ = _summed(with_units, model, _leaf_counts, len(language))
    model.levels = []  # from here on units are placed by terms
    model.leaves = [np.flatnonzero(language == x) for x in range(len(group))]
    model.leaf_weights = [_fit_weights(counts[x]) for x in model.leaves]
    counts, _ = _summed(with_units, model, _leaf_counts, len(language))

    at = {s: i for i, s in enumerate(subjects)}
    m = len(subjects)

    def by_subject(model: Model, batch: pa.RecordBatch):
        own = Rows(batch, model)
        key = own.language * m + np.array([at[s] for s in batch["__subject"].to_pylist()], np.int64)
        return key[own.row], own.words, None, np.bincount(key[own.kept], minlength=1)

    hand, _ = _summed(labelled, model, by_subject, len(group) * m)
    hand = hand.reshape(len(group), m, DIMENSIONS)
    label = np.full(len(language), other)
    for again in (True, False):
        for x, leaves in enumerate(model.leaves):
            label[leaves] = label_leaves(counts[leaves], hand[x], other)
            model.leaf_weights[x] = _against_rivals(counts[leaves], label[leaves], m)
        if again:
            counts, _ = _summed(with_units, model, _leaf_counts, len(language))
    model.rarity = model.rarity[:0]
    final = base.sparkSession.sparkContext.broadcast((model, label))

    def mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, label = final.value
        for batch in batches:
            own = Rows(batch, model)
            _, _, row, leaf, kept = model.placed(batch, own)
            subject = np.where(leaf >= 0, label[leaf], other)[kept]
            mix = np.bincount(row[kept] * m + subject, minlength=own.n * m).reshape(own.n, m)
            size = mix.sum(1)
            share = mix / np.maximum(size, 1)[:, None]
            holds = mix >= LEAST_SHARE * np.maximum(size, 1)[:, None]
            holds[:, other] = ~np.delete(holds, other, 1).any(1)
            r, s = np.nonzero(holds & own.kept[:, None])
            yield pa.RecordBatch.from_pydict({"row_id": batch["row_id"].take(pa.array(r)), "subject": pa.array([subjects[x] for x in s], pa.string()), "share": pa.array(share[r, s])})

    return base.mapInArrow(mixed, "row_id long, subject string, share double")


def subject_mix(assigned: DataFrame, texts: DataFrame) -> DataFrame:
    """(source, domain_filter, subject, n_rows): how many rows of each source and filter hold each subject."""
    return assigned.join(texts.select("row_id", "source", "domain_filter"), "row_id").groupBy("source", "domain_filter", "subject").agg(F.countDistinct("row_id").alias("n_rows"))
