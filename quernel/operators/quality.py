"""Quality filters over documents."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quernel.functions.text import alpha_words, phrase_hits, word_count

# Fixed values.
BOILERPLATE = ["click here", "subscribe now", "follow us", "all rights reserved", "sign up", "log in", "newsletter", "terms of service", "privacy policy", "cookie"]
STOPWORDS = """
    the a an and or but if of to in on at by for with as is was were are be been being
    it its this that these those he she they we you i his her their our your my him
    them us me not no so up out about into over after before than then there here what
    which who when where how all any each other some such only own same too very just
    also one would could should will shall can may might must do does did have has had
    from
""".split()


def is_article(text: Column, least_words: int = 500, most_words: int = 5000, phrases: list[str] = BOILERPLATE) -> Column:
    """An article's length and fewer than two boilerplate phrases; false for null."""
    n = word_count(text)
    return F.coalesce((n >= least_words) & (n <= most_words), F.lit(False)) & (phrase_hits(text, phrases) < 2)


def words_that_return(least_letters: int = 5, least_gap: int = 15, stopwords: list[str] = STOPWORDS):
    """A function Column -> Column: the words of a text that come again at least ``least_gap`` words after their first place.

    First and last places of a row's words are kept in one pass over the row, in Arrow batches, so no word is shuffled.
    """
    passed, find = frozenset(stopwords), re.compile("[a-z']+").findall

    def returning(text: str | None) -> list[str]:
        words = find(text) if text else []
        last = {w: i for i, w in enumerate(words)}
        first = {w: i for i, w in zip(range(len(words) - 1, -1, -1), reversed(words))}
        return [w for w, i in last.items() if i - first[w] >= least_gap and len(w) >= least_letters and w not in passed]

    told = pandas_udf(lambda texts: texts.map(returning), "array<string>")
    return lambda text: told(F.lower(text))


def copy_words(docs: DataFrame, least_letters: int = 5, least_gap: int = 15, stopwords: list[str] = STOPWORDS) -> DataFrame:
    """(doc_id, word): words of some length that come again at least ``least_gap`` words after their first place.

    Null and empty texts have none; repeated rows have theirs each.
    """
    return docs.select("doc_id", F.explode(words_that_return(least_letters, least_gap, stopwords)(F.col("text"))).alias("word"))


def copy_structured(docs: DataFrame, **options) -> DataFrame:
    """The documents in which some word comes again."""
    return docs.where(F.size(words_that_return(**options)(F.col("text"))) > 0)


def url_matches(url: Column, parts: list[str]) -> Column:
    """Whether a URL holds any of the parts."""
    hit = F.lit(False)
    for p in parts:
        hit = hit | F.contains(url, F.lit(p))
    return F.coalesce(hit, F.lit(False))
