"""The licence of each code file and repository (problem 4).

A statement is a set of licences: one, or several to choose from. Statements are read from declared licence
fields, from phrases that declare ("SPDX-License-Identifier:", "Licensed under ..."), and from wording.

Wording is located with a generalized suffix automaton of all templates: one walk over a text's words gives
its maximal exact matches, those in order are chained per template over reworded gaps, and a chain counts
only if it covers enough of its template. Where sibling templates share wording, the chain with more of the
text wins; a stretch that fits another template as well, however little of that it covers, is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quernel.session import bounded_rows

#: Templates beyond this are refused rather than broadcast.
MOST_TEMPLATES = 5_000
#: A maximal match of fewer words is chance.
LEAST_WORDS = 3
#: Reworded words that may lie between two matches of a chain, on either side.
GAP_WORDS = 8
#: Share of a template's words that a chain must match.
LEAST_COVER = 0.5

# How families of licences are commonly called, by the first part of their ids (patterns over text of any
# case, words apart as they come). A family that isn't here is called by its id alone.
FAMILIES = {
    "agpl": r"agpl|(?:gnu )?affero (?:general public licen[sc]e|gpl)",
    "apache": r"apache(?: software)?(?: licen[sc]e)?|asl",
    "bsl": r"bsl|boost(?: software)?(?: licen[sc]e)?",
    "cddl": r"cddl|common development and distribution licen[sc]e",
    "epl": r"epl|eclipse public licen[sc]e",
    "eupl": r"eupl|european union public licen[sc]e",
    "gpl": r"(?:gnu[\s_-]*)?gpl|(?:gnu )?general public licen[sc]e",
    "isc": r"isc|internet[\s-]consortium licen[sc]e",
    "lgpl": r"lgpl|(?:gnu )?(?:lesser|library) (?:general public licen[sc]e|gpl)",
    "mit": r"mit|expat",
    "mpl": r"mpl|mozilla public licen[sc]e",
    "unlicense": r"public[\s-]domain dedication \(unlicense\)|unlicense",
}
#: How the forms of a family that differ in their clauses are called besides.
CLAUSES = {
    "2": r"(?:simplified|freebsd(?:-style)?) {0}(?: licen[sc]e)?|freebsd(?:-style)? licen[sc]e",
    "3": r"(?:new|modified|revised) {0}(?: licen[sc]e)?",
}
_TAIL = r"(?:[\s_-]+(?:only|or[\s_-]later)|\+)?(?:\s+licen[sc]e)?"
_ID = re.compile(r"(?P<stem>.+?)(?:-(?P<clauses>\d)-clause|-(?P<version>\d+(?:\.\d+)*))?", re.I)


def called(licence: str) -> str:
    """The pattern of the names of a licence, made from its id: family, and version or number of clauses."""
    m = _ID.fullmatch(licence)
    stem = m["stem"].lower()
    family = FAMILIES.get(stem) or r"[\s_-]*".join(map(re.escape, re.split(r"[\s_-]+", stem)))
    if m["clauses"]:
        n = m["clauses"]
        return rf"(?:{family})[\s_-]*{n}[\s_-]*clause|{n}[\s_-]*clause (?:{family})|{CLAUSES.get(n, '(?!)').format(f'(?:{family})')}"
    if m["version"]:
        whole = re.sub(r"(?:\.0)+$", "", m["version"])
        return rf"(?:{family})(?: licen[sc]e)?(?:,? version)?[\s_-]*v?{re.escape(whole)}(?:\.0)*"
    return family


class Names:
    """Finds licences by name. Longer families come first, so that what holds another's name isn't taken for it."""

    def __init__(self, licences: Iterable[str]):
        self.ids = sorted(licences, key=lambda x: (-len(_ID.fullmatch(x)["stem"]), x))
        any_name = "|".join(f"(?P<n{i}>(?<![a-z0-9.-])(?:{called(x)}){_TAIL}(?![a-z0-9]))" for i, x in enumerate(self.ids))
        self.pattern = re.compile(any_name or "(?!)", re.I)

    def id(self, m: re.Match) -> str:
        return self.ids[int(m.lastgroup[1:])]

    def joined(self, text: str, at: int) -> tuple[set[str], int]:
        """The licences named one after another, joined by or, from ``at`` on, and where the last name ends."""
        ids: set[str] = set()
        end = at
        while m := self.pattern.match(text, at):
            ids.add(self.id(m))
            end = m.end()
            joiner = _JOINER.match(text, end)
            if not joiner:
                break
            at = joiner.end()
        return ids, end

    def declared(self, text: str) -> list[frozenset[str]]:
        """The statements that declaring phrases make in a text whose comment markers are gone."""
        found = (self.joined(text, _CHOICE.match(text, intro.end()).end())[0] for intro in _DECLARES.finditer(text))
        return [frozenset(ids) for ids in found if ids]


_JOINER = re.compile(r"\s*(?:,?\s*\bor\b,?(?:\s*at your option,)?|/|\|)\s*(?:the\s+)*", re.I)
_ARTICLE = re.compile(r"(?:the\s+)*", re.I)
_CHOICE = re.compile(r"(?:either\s+)?(?:the\s+)*", re.I)
#: Phrases that declare; what follows them is a name or several to choose from.
_DECLARES = re.compile(
    r"spdx-license-identifier:\s*|@licen[sc]e[ \t]+|(?:^|\|)[ \t]*licen[sc]e:[ \t]*|\blicen[sc]ed\s+under\s+|\bdistributed\s+under\s+"
    r"|\bunder\s+the\s+terms\s+of\s+|\bavailable\s+under\s+|\breleased\s+under\s+|\bdual-licen[sc]ed:?\s*(?:under\s+)?|\bunder\s+either\s+",
    re.I | re.M,
)
_MARKER = re.compile(r"^[ \t]*(?:/\*+!?|\*+/?|//+|#+|--+|\"{3}|'{3}|;+|%+|<!--)[ \t]?", re.M)
_WORD = re.compile(r"[a-z0-9]+(?:['’][a-z]+)?")
_EITHER = re.compile(r"\beither\b|\bor\b\W*at your option|\bdual-licen|\byour choice\b|as you prefer|--\s*or\s*--", re.I)


class TemplateAutomaton:
    """Generalized suffix automaton over the words of the templates."""

    def __init__(self, templates: dict[str, str]):
        self.length = {k: len(_WORD.findall(t.lower())) for k, t in templates.items()}
        self.next: list[dict[str, int]] = [{}]
        self.link = [-1]
        self.longest = [0]
        self.ends: list[list[tuple[str, int]]] = [[]]
        for key, text in templates.items():
            last = 0
            for at, word in enumerate(_WORD.findall(text.lower())):
                last = self._extend(last, word)
                self.ends[last].append((key, at))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.longest[s]):
            self.ends[self.link[state]].extend(self.ends[state])

    def _new(self, longest: int, following: dict[str, int], link: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.longest.append(longest)
        self.ends.append([])
        return len(self.next) - 1

    def _split(self, p: int, word: str, q: int) -> int:
        clone = self._new(self.longest[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: str) -> int:
        q = self.next[last].get(word)
        if q is not None:
            return q if self.longest[q] == self.longest[last] + 1 else self._split(last, word, q)
        state, p = self._new(self.longest[last] + 1, {}, 0), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[state] = q if self.longest[q] == self.longest[p] + 1 else self._split(p, word, q)
        return state

    def matches(self, words: list[str]) -> Iterator[tuple[int, int, int]]:
        """(end in the words, length, state) of every maximal exact match of at least ``LEAST_WORDS``."""
        state = size = 0
        for at, word in enumerate(words):
            following = self.next[state].get(word)
            if following is not None:
                state, size = following, size + 1
                continue
            if size >= LEAST_WORDS:
                yield at, size, state
            while state and word not in self.next[state]:
                state = self.link[state]
            size = self.longest[state]
            if word in self.next[state]:
                state, size = self.next[state][word], size + 1
        if size >= LEAST_WORDS:
            yield len(words), size, state

    def located(self, words: list[str]) -> list[tuple[str, int, int, float]]:
        """(template, first word, end word, cover) of each template found in the words."""
        chains: dict[str, list[list[int]]] = {}
        for end, size, state in self.matches(words):
            for key, at in set(self.ends[state]):
                mine = chains.setdefault(key, [])
                best = None
                for c in reversed(mine):  # chain: [first word, end word, end in template, matched]
                    if end - size - c[1] > GAP_WORDS:
                        break  # starts and ends only grow, so no earlier chain is near enough either
                    if end - size >= c[1] - LEAST_WORDS and 0 < at + 1 - c[2] and at + 1 - size - c[2] <= GAP_WORDS:
                        if best is None or c[3] > best[3]:
                            best = c
                if best:
                    gain = min(size, at + 1 - best[2], end - best[1])
                    mine.append([best[0], end, at + 1, best[3] + max(0, gain)])
                else:
                    mine.append([end - size, end, at + 1, size])
        found = [(key, c[0], c[1], c[3] / self.length[key], c[3]) for key, mine in chains.items() for c in mine if c[3] >= LEAST_COVER * self.length[key]]
        found.sort(key=lambda x: (-x[4], -x[3], x[0]))
        kept: list[tuple[str, int, int, float, int]] = []
        for x in found:
            if not any(x[1] < y[2] and y[1] < x[2] for y in kept):
                kept.append(x)
        rivals = [(key, c[0], c[1], c[3]) for key, mine in chains.items() for c in mine]
        return [x[:4] for x in kept if not any(r[0] != x[0] and r[3] >= x[4] and r[1] < x[2] and x[1] < r[2] for r in rivals)]


class LicenceReader:
    """Reads statements. ``templates`` maps licence ids to their wording; the names come from the ids."""

    def __init__(self, templates: dict[str, str]):
        self.names = Names(templates)
        self.automaton = TemplateAutomaton({k: t for k, t in templates.items() if t})

    def field(self, value: str | None) -> list[frozenset[str]]:
        """A declared licence field: a name, or names joined by or; anything else states nothing."""
        text = (value or "").strip()
        ids, end = self.names.joined(text, _ARTICLE.match(text).end())
        return [frozenset(ids)] if ids and not text[end:].strip(" .;)") else []

    def code(self, value: str | None) -> list[frozenset[str]]:
        """Source code: declaring phrases and wording in it. Names alone are mentions."""
        if not value:
            return []
        text = _MARKER.sub("", value)
        wording = self.automaton.located(_WORD.findall(text.lower()))
        return self.names.declared(text) + [frozenset([x[0]]) for x in wording]

    def text(self, value: str | None) -> list[frozenset[str]]:
        """A licence file: every name and wording in it; where it offers a choice, all of them are one statement."""
        if not value or value.isspace():
            return []
        text = _MARKER.sub("", value)
        named = {self.names.id(m) for m in self.names.pattern.finditer(text)}
        worded = {x[0] for x in self.automaton.located(_WORD.findall(text.lower()))}
        if len(named | worded) > 1 and _EITHER.search(text):
            return [frozenset(named | worded)]
        return [frozenset([x]) for x in named | worded]


def allowed(statements: list[frozenset[str]]) -> str:
    """What all statements allow: licence ids joined by OR, ``conflict`` if none, ``unknown`` without a statement."""
    if not statements:
        return "unknown"
    both = frozenset.intersection(*statements)
    return " OR ".join(sorted(both)) if both else "conflict"


def findings(code_files: DataFrame, repositories: DataFrame, templates: DataFrame) -> DataFrame:
    """(item_kind, item_id, finding): one row per code file and per repository.

    Statements travel as short strings: each repository's are read once and joined to its files, so a
    repository that holds a third of all files costs a broadcast-or-shuffle of licence ids, never of texts.
    Files without a repository, or whose repository is missing, stand alone. Null fields state nothing.
    A repeated repository id is read as one repository with all its statements.
    """
    rows = bounded_rows(templates.select("license_id", "body").where("license_id is not null"), MOST_TEMPLATES, "the licence templates")
    reader = code_files.sparkSession.sparkContext.broadcast(LicenceReader({r.license_id: r.body or "" for r in rows}))

    def pack(statements: list[frozenset[str]]) -> list[str]:
        return sorted({"|".join(sorted(s)) for s in statements})

    @pandas_udf("array<string>")
    def repository_statements(fields: pd.Series, texts: pd.Series) -> pd.Series:
        r = reader.value
        return pd.Series([pack(r.field(f) + r.text(t)) for f, t in zip(fields, texts)])

    @pandas_udf("array<string>")
    def file_statements(fields: pd.Series, codes: pd.Series) -> pd.Series:
        r = reader.value
        return pd.Series([pack(r.field(f) + r.code(c)) for f, c in zip(fields, codes)])

    sets = lambda c: F.transform(c, lambda s: F.split(s, "\\|"))

    def verdict(statements):
        parts = sets(statements)
        both = F.aggregate(parts, F.element_at(parts, 1), lambda a, b: F.array_intersect(a, b))
        stated = F.when(F.size(both) == 0, "conflict").otherwise(F.array_join(F.array_sort(both), " OR "))
        return F.when(F.size(statements) == 0, "unknown").otherwise(stated)

    repos = repositories.select(
        F.col("repo_id").alias("__repo"), repository_statements("license", "license_text").alias("__said")
    )
    own = repos.select(F.lit("repo").alias("item_kind"), F.col("__repo").alias("item_id"), verdict(F.col("__said")).alias("finding"))
    merged = repos.groupBy("__repo").agg(F.array_distinct(F.flatten(F.collect_set("__said"))).alias("__said"))
    files = code_files.select("file_id", "repo_id", file_statements("license", "code").alias("__own"))
    joined = files.join(merged, files.repo_id == merged["__repo"], "left")
    said = F.array_union(F.col("__own"), F.coalesce(F.col("__said"), F.array().cast("array<string>")))
    return joined.select(F.lit("file").alias("item_kind"), F.col("file_id").alias("item_id"), verdict(said).alias("finding")).unionByName(own)
