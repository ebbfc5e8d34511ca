"""Text functions as Columns. They stay in generated code; none calls Python.

Patterns avoid what regex dialects disagree on: no lookaround, no ``\\b``, explicit Unicode classes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS_AND_SIGNS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def word_count(text: Column) -> Column:
    """Runs of characters that aren't white space; null for null."""
    return F.regexp_count(text, F.lit(r"\S+")).cast("long")


def byte_count(text: Column) -> Column:
    """Length in UTF-8 bytes."""
    return F.octet_length(text).cast("long")


def words(text: Column) -> Column:
    """The runs that ``word_count`` counts."""
    return F.regexp_extract_all(text, F.lit(r"(\S+)"), 1)


def snippet(text: Column, n: int | Column) -> Column:
    """The first ``n`` words joined by one space."""
    return F.array_join(F.slice(words(text), F.lit(1), F.lit(n) if isinstance(n, int) else n), " ")


def alpha_words(text: Column) -> Column:
    """Runs of ASCII letters and apostrophes in the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z']+)"), 1)


def words_and_signs(text: Column) -> Column:
    """Words and single signs of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORDS_AND_SIGNS})"), 1)


def not_blank(text: Column) -> Column:
    """Whether a text holds anything but white space; false for null."""
    return F.coalesce(text.rlike(r"\S"), F.lit(False))


def tagged(tag: Column, body: Column, separator: str = "") -> Column:
    """A body under its domain tag."""
    return F.concat(tag, F.lit("\n"), body, F.lit(separator))


def context_and_target(text: Column) -> tuple[Column, Column]:
    """A text split at its last space; null parts where it has none."""
    has = F.instr(text, " ") > 0
    pattern = r"(?s)^(.*) ([^ ]*)$"
    return F.when(has, F.regexp_extract(text, pattern, 1)), F.when(has, F.regexp_extract(text, pattern, 2))


def strip_signs(text: Column) -> Column:
    """A word without the signs .,;:!?"' at its ends."""
    return F.regexp_replace(F.regexp_replace(text, r"^[.,;:!?\"']+", ""), r"[.,;:!?\"']+$", "")


def canonical_piece(piece: Column) -> Column:
    """A token's text without word markers, underscores and spaces at its ends, lower-cased."""
    return F.lower(F.regexp_replace(F.regexp_replace(piece, "^[▁_ ]+", ""), "[▁_ ]+$", ""))


def html_escaped(text: Column) -> Column:
    """& < > " ' as entities."""
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def allowed_code(code: Column, language: Column, license_: Column, languages: list[str], licenses: list[str]) -> Column:
    """Code whose language and licence are allowed, else null."""
    return F.when(F.lower(F.trim(language)).isin(languages) & F.lower(F.trim(license_)).isin(licenses), code)


def phrase_hits(text: Column, phrases: list[str]) -> Column:
    """How many of the phrases a lower-cased text holds."""
    low = F.lower(text)
    hits = F.lit(0)
    for p in phrases:
        hits = hits + F.contains(low, F.lit(p)).cast("int")
    return F.coalesce(hits, F.lit(0)).cast("long")
