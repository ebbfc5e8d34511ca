"""Rule classifiers: counted pattern hits, priorities and thresholds, all inside generated code."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Label:
    """A label and the patterns whose hits count for it."""

    name: str
    patterns: tuple[str, ...]


# The patterns of the built-in classifiers. A label's score is the number of its patterns' matches.
DOMAINS = (
    Label("code", (
        r"\b(def |class |import |function\(|const |let |var |return |public static|#include|package |void |print\(|console\.log)\b",
        r"[{};]\s*$|^\s{2,}\S|=>|::|->",
    )),
    Label("math", (
        r"\\(frac|sum|int|sqrt|alpha|beta|theta|partial|infty|leq|geq)|\\\[|\\\(|\$[^$\n]{0,40}(\\[a-zA-Z]+|\^|_|\\frac)[^$\n]{0,40}\$",
        r"(?i)\b(theorem|lemma|proof|equation|corollary|axiom|integral|derivative|matrix|eigenvalue|polynomial)\b",
    )),
    Label("science", (
        r"(?i)\b(et al\.?|hypothesis|experiment(al)?|methodology|abstract|we (observe|report|show|find)|figure \d|table \d|arxiv|doi:|p\s*<\s*0\.0\d|statistically significant)\b",
    )),
)
REGISTERS = (
    Label("nlp_news", (r"(?i)\b(according to|reported|announced|said (on|in)|officials|spokesperson|\d{1,2}:\d{2}\s*(am|pm)|(mon|tue|wed|thu|fri|sat|sun)day)\b",)),
    Label("nlp_opinion", (r"(?i)\b(i think|i believe|in my opinion|imo|honestly|personally|should(n't)? |i (love|hate|feel))\b",)),
    Label("nlp_narrative", (r"""(?i)"\s*[A-Z][^"]{3,40}[.!?]\s*"|(\bhe|\bshe) (said|whispered|shouted|walked|looked)\b""",)),
    Label("nlp_reference", (r"(?i)\b(is a|refers to|is defined as|is the|consists of|is used to|is one of|is known as)\b",)),
)

#: Classes of letters and boundaries follow Unicode.
_UNICODE = "(?U)"


def hits(text: Column, label: Label) -> Column:
    """Hits of all the label's patterns."""
    total = F.lit(0)
    for pattern in label.patterns:
        total = total + F.regexp_count(text, F.lit(_UNICODE + pattern))
    return total


def classified(text: Column, labels: tuple[Label, ...], default: Column, sample: int | None, threshold: int) -> Column:
    """The label with most hits if these reach the threshold, earlier labels first on ties, else ``default``.

    Null and blank texts get ``default``. ``sample`` restricts a classifier that is defined on a text's start
    (None: whole texts).
    """
    seen = F.coalesce(F.substring(text, 1, sample) if sample else text, F.lit(""))
    counts = [F.when(seen.rlike(r"\S"), hits(seen, label)).otherwise(0) for label in labels]
    names = F.array(*[F.lit(label.name) for label in labels])
    # The counts are bound to a variable: they are used three times and must be taken once.
    bound = F.transform(F.array(F.array(*counts)), lambda c: F.when(F.array_max(c) >= threshold, F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))))
    return F.coalesce(F.element_at(bound, 1), default)
