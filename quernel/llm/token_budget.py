"""Token counts under an existing tokenizer and their totals (problem 2).

Both counters share one form. Texts are pre-split, each batch keeps only the *distinct* pieces it has not
met before, as symbol arrays laid end to end, and a table of adjacent pairs is joined to them again and
again until no pair joins any more:

* ``PieceTable`` holds the pieces of a vocabulary without merge ranks, as (prefix, next symbol) ->
  longer prefix. A position's prefix grows by one symbol per join; the longest accepted prefix is its token.
* ``MergeTable`` holds the merges of a byte-level BPE tokenizer as (left, right) -> (rank, merged). Each
  round applies a piece's lowest-ranked merges.

Both tables are sized by the tokenizer, not by the data.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quernel.session import bounded_rows

#: How a text is cut before pieces are looked up.
PRE_SPLIT = r"[ ]?[A-Za-zÀ-ɏ]+|[ ]?[0-9]{1,3}|[ \t\r\n]+|[ ]?[^ \t\r\nA-Za-z0-9À-ɏ]+"

#: A vocabulary beyond this is refused rather than broadcast.
MOST_PIECES = 2_000_000
#: Texts are handled in runs of about so many characters, so that a batch's pieces never all exist at once.
RUN_CHARS = 1_000_000
#: Distinct pieces that a worker remembers before it forgets them all; it bounds memory and changes no count.
MOST_REMEMBERED = 400_000


def _join(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``wanted`` in the sorted ``keys`` and whether they are there."""
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


class PieceTable:
    """Counts longest-match tokens; a character that starts no piece counts one per UTF-8 byte."""

    def __init__(self, pieces: Iterable[str]):
        pieces = sorted({p for p in pieces if p})
        self.symbols = np.array(sorted({ord(c) for p in pieces for c in p}), np.int64)
        symbol = {int(c): i for i, c in enumerate(self.symbols)}
        self.width = max(1, len(self.symbols))
        pairs: dict[tuple[int, int], int] = {}
        accepted = [False]
        for piece in pieces:
            state = 0
            for c in piece:
                pair = (state, symbol[ord(c)])
                if pair not in pairs:
                    pairs[pair] = len(accepted)
                    accepted.append(False)
                state = pairs[pair]
            accepted[state] = True
        keys = np.array([a * self.width + b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.longer = keys[order], np.array(list(pairs.values()), np.int64)[order]
        self.accepted = np.array(accepted)

    def counts(self, pieces: list[str]) -> np.ndarray:
        if not pieces:
            return np.zeros(0, np.int64)
        text = "".join(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        ends = np.cumsum(lengths)
        end_of = np.repeat(ends, lengths)
        symbol, known = _join(self.symbols, codes)
        longest = np.zeros(len(codes), np.int64)
        at = np.flatnonzero(known)
        state = np.zeros(len(at), np.int64)
        step = 0
        while len(at):
            next_at, joined = _join(self.keys, state * self.width + symbol[at + step])
            at, state = at[joined], self.longer[next_at[joined]]
            step += 1
            longest[at[self.accepted[state]]] = step
            inside = at + step < end_of[at]
            at, state = at[inside], state[inside]
            inside = known[at + step]
            at, state = at[inside], state[inside]
        cost = np.where(longest > 0, 1, 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))
        after = np.arange(len(codes)) + np.maximum(longest, 1)
        total = np.zeros(len(pieces), np.int64)
        live = np.arange(len(pieces))
        spot = ends - lengths
        while len(live):
            total[live] += cost[spot]
            spot = after[spot]
            inside = spot < ends[live]
            live, spot = live[inside], spot[inside]
        return total


class MergeTable:
    """Counts byte-level BPE tokens, given the ranks of the token byte strings."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values(), default=0) + 1
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        keys, merged = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.size + right)
                    merged.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.merged = np.array(keys, np.int64)[order], np.array(merged, np.int64)[order]

    @classmethod
    def from_tiktoken(cls, path: str) -> MergeTable:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def counts(self, pieces: list[str]) -> np.ndarray:
        encoded = [p.encode("utf-8", "replace") for p in pieces]
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
        total = lengths.copy()
        symbols = self.single[np.frombuffer(b"".join(encoded), np.uint8)]
        piece = np.repeat(np.arange(len(pieces)), lengths)
        far = np.int64(self.size)
        while len(symbols) > 1:
            at, joined = _join(self.keys, symbols[:-1] * self.size + symbols[1:])
            joined &= (piece[:-1] == piece[1:]) & (symbols[:-1] >= 0) & (symbols[1:] >= 0)
            if not joined.any():
                break
            rank = np.where(joined, self.merged[at], far)
            least = np.full(len(pieces), far)
            np.minimum.at(least, piece[:-1], rank)
            chosen = joined & (rank == least[piece[:-1]])
            # Of overlapping equal pairs (aaa) the left one merges: keep every other pair of a run.
            spots = np.flatnonzero(chosen)
            first = np.r_[True, np.diff(spots) > 1]
            start = np.maximum.accumulate(np.where(first, np.arange(len(spots)), 0))
            spots = spots[(np.arange(len(spots)) - start) % 2 == 0]
            symbols[spots] = rank[spots]
            total -= np.bincount(piece[spots], minlength=len(pieces))
            keep = np.ones(len(symbols), bool)
            keep[spots + 1] = False
            live = np.zeros(len(pieces), bool)
            live[piece[spots]] = True  # a piece in which nothing merged has converged
            keep &= live[piece]
            symbols, piece = symbols[keep], piece[keep]
        return total


def _counted(batches: Iterator[pd.Series], table, find) -> Iterator[pd.Series]:
    known: dict[str, int] = {}
    for texts in batches:
        totals = np.zeros(len(texts), np.int64)
        run: list[tuple[int, list[str]]] = []
        chars = 0

        def settle(run=run, totals=totals):
            fresh = list({p for _, pieces in run for p in pieces if p not in known})
            if fresh:
                if len(known) > MOST_REMEMBERED:
                    known.clear()
                    fresh = list({p for _, pieces in run for p in pieces})
                known.update(zip(fresh, table.counts(fresh).tolist()))
            for i, pieces in run:
                totals[i] = sum(map(known.__getitem__, pieces))
            run.clear()

        for i, text in enumerate(texts):
            if text:
                run.append((i, find(text)))
                chars += len(text)
                if chars > RUN_CHARS:
                    settle()
                    chars = 0
        settle()
        yield pd.Series(totals)


def vocabulary_counter(vocab: DataFrame, piece_col: str = "piece"):
    """A function Column -> Column that counts a text's tokens under a vocabulary of pieces (longest match).

    Null and empty texts have 0 tokens. Null or empty pieces are ignored, repeated ones count once.
    """
    rows = bounded_rows(vocab.select(F.col(piece_col).alias("p")).where("p is not null"), MOST_PIECES, "the vocabulary")
    shared = vocab.sparkSession.sparkContext.broadcast(PieceTable(r.p for r in rows))

    @pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return _counted(batches, shared.value, re.compile(PRE_SPLIT).findall)

    return count


def bpe_counter(spark, ranks_path: str, pattern: str):
    """As ``vocabulary_counter``, for a byte-level BPE tokenizer whose ranks lie in a tiktoken file.

    ``ranks_path`` is read once on the driver; the executors get the merge table, not the path.
    """
    shared = spark.sparkContext.broadcast(MergeTable.from_tiktoken(ranks_path))

    @pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import regex

        return _counted(batches, shared.value, regex.compile(pattern).findall)

    return count


def with_token_counts(docs: DataFrame, counter, text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """``docs`` with the column ``out_col`` (replaced if it exists), the tokens of ``text_col``."""
    return docs.withColumn(out_col, counter(F.col(text_col)))


def token_totals(docs: DataFrame, counter, keys: list[str], text_col: str = "text") -> DataFrame:
    """Documents and tokens per ``keys`` (null keys form a group of their own).

    Only the keys and the count leave the scan stage, and they are summed before the shuffle, so a source
    that holds a third of the rows costs one row per task.
    """
    counted = docs.select(*keys, F.col(text_col).alias("__text")).withColumn("__n", counter(F.col("__text")))
    return counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("__n").alias("n_tokens"))


def misreported_slices(shard_source: DataFrame, totals: DataFrame, tolerance: float = 0.15) -> DataFrame:
    """Slices whose reported ``actual_tokens`` is off the true total by more than ``tolerance`` of it.

    ``totals`` has shard_id, source, lang, n_tokens; a slice without documents has 0 true tokens, so any
    other report is wrong. Null reports are no statement and never wrong. Null keys are equal to each other.
    """
    s, t = shard_source.select("shard_id", "source", "lang", "actual_tokens").alias("s"), totals.alias("t")
    same: Column = F.lit(True)
    for key in ("shard_id", "source", "lang"):
        same = same & F.col(f"s.{key}").eqNullSafe(F.col(f"t.{key}"))
    true = F.coalesce(F.col("t.n_tokens"), F.lit(0))
    return (
        s.where("actual_tokens is not null")
        .join(t, same, "left")
        .where(F.abs(F.col("s.actual_tokens") - true) > tolerance * true)
        .select("s.shard_id", "s.source", "s.lang")
        .distinct()
    )
