"""Vocabularies, segment counts and words encoded with backoff. Tokenizers are applied here, not trained."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ids that every sub-vocabulary keeps for itself: pad, unk, bos, eos; bytes follow directly.
RESERVED = 4
SYLLABLES = r"[^aeiouy]*[aeiouy]+|[^aeiouy]+"
PREFIXES = ("un", "re", "in", "dis", "over", "pre")
SUFFIXES = ("ing", "ed", "ly", "ness", "ment", "er", "est", "s")


def word_counts(docs: DataFrame, words: Column) -> DataFrame:
    """(word, n): how often each word occurs; partial counts are combined before the shuffle."""
    return docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def syllables(word: Column) -> Column:
    """A word's vowel groups with what stands before them."""
    return F.regexp_extract_all(word, F.lit(f"({SYLLABLES})"), 1)


def morphemes(word: Column) -> Column:
    """A word as prefix, stem and suffix of the known affixes, where the stem keeps three letters."""
    pattern = rf"^({'|'.join(PREFIXES)})?([a-z']{{3,}}?)({'|'.join(SUFFIXES)})?$"
    parts = F.array(*[F.regexp_extract(word, pattern, i) for i in (1, 2, 3)])
    return F.when(word.rlike(pattern), F.filter(parts, lambda x: x != "")).otherwise(F.array(word))


def segment_counts(counts: DataFrame, segments: Column) -> DataFrame:
    """(segment, n): segments of the counted words, weighted by the words' counts."""
    return counts.select(F.explode(segments).alias("segment"), "n").groupBy("segment").agg(F.sum("n").alias("n"))


def top_pieces(counts: DataFrame, piece: str, size: int, first_id: int = RESERVED) -> DataFrame:
    """(piece, id, n): the ``size`` most frequent pieces, ties by the piece; ids follow the order.

    The order is global, but only the heaviest pieces are ranked: a limit over the counts comes first,
    which each task applies to its own before one task merges them.
    """
    head = counts.orderBy(F.desc("n"), piece).limit(size)
    rank = F.row_number().over(Window.orderBy(F.desc("n"), piece))
    return head.select(F.col(piece).alias("piece"), (rank - 1 + first_id).cast("long").alias("id"), "n")


def backoff_levels(counts: DataFrame, surface: DataFrame, syllable: DataFrame, morpheme: DataFrame) -> DataFrame:
    """(word, n, level, n_tokens): the first level all of whose segments are known; bytes know every word.

    Each distinct word is segmented once, whatever its count.
    """
    def known(segments: Column, vocab: DataFrame, level: str) -> DataFrame:
        told = counts.select("word", F.posexplode(segments).alias("p", "piece")).join(vocab.select("piece").withColumn("hit", F.lit(1)), "piece", "left")
        return told.groupBy("word").agg(F.every(F.col("hit").isNotNull()).alias(level), F.count(F.lit(1)).alias(f"n_{level}"))

    word = F.col("word")
    joined = counts.join(known(F.array(word), surface, "surface"), "word").join(known(syllables(word), syllable, "syllable"), "word").join(known(morphemes(word), morpheme, "morpheme"), "word")
    level = F.when(F.col("surface"), "surface").when(F.col("syllable"), "syllable").when(F.col("morpheme"), "morpheme").otherwise("byte")
    size = F.when(F.col("surface"), 1).when(F.col("syllable"), F.col("n_syllable")).when(F.col("morpheme"), F.col("n_morpheme")).otherwise(F.octet_length("word"))
    return joined.select("word", "n", level.alias("level"), size.cast("long").alias("n_tokens"))


def pair_counts(counts: DataFrame) -> DataFrame:
    """(a, b, n): adjacent characters in the counted words, each weighted by its word's count."""
    pairs = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.struct(F.substring("word", i, F.lit(1)).alias("a"), F.substring("word", i + 1, F.lit(1)).alias("b")))
    told = counts.where(F.length("word") > 1).select(F.explode(pairs).alias("p"), "n")
    return told.groupBy("p.a", "p.b").agg(F.sum("n").alias("n"))
