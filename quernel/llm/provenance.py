"""Generated, minified, vendored and data files among source files (problem 3).

Some files say in a header notice that they weren't written by hand, some lie where such files lie (``gen/``,
``x.min.js``, ``third_party/lib/``). These are the labels, and both are hidden from the features: notices are taken out
before anything is measured, every feature but the comment density is computed on the code without its
comments, and paths are no feature. A random forest is trained twice on compression ratio, token entropy, identifier
lengths, comment density and the like, and overlap with library files: the first, fitted on the other folds, tells which
files without a label look like labelled ones and the other way round, and the second is trained without those, as
what they are isn't known. The second forest scores every file, labelled or not.

A file is a case where the forest says so, or where it is declared to be one: by its own notice, or by lying in the folder
of an outside library. Generated code and the code of a library that isn't known can look as if written by hand
here, and then nothing else tells. Other folders and names make no case alone.

The forest is fitted on at most ``MOST_ROWS`` rows of each label, drawn by hash; every file is scored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quernel.session import checkpointed

#: Rows of each label that a forest is fitted on at most.
MOST_ROWS = 20_000
#: Runs of library words up to this many are broadcast; beyond it files' runs are joined to them by shuffle.
MOST_RUNS = 5_000_000
SHINGLE = 5
TREES, DEPTH, SEED, FOLDS = 40, 6, 7, 2

# What files say of themselves, in header comments and in paths.
NOTICES = re.compile(
    r"@generated\b|\bauto-?generated\b(?! by hand)|\bcode generated by\b|\b(?:re)?built from \S+ on every\b|\bmachine-(?:made|generated)\b"
    r"|\boutput of \S+ [\d.]+ \(input\b|\bautomatically (?:created|generated)\b|\bgenerated (?:on|from|with) [^\n]*(?:edit|modify|overwrit)"
    r"|\bon [\d-]+; edit \S+ instead|\bne pas modifier\b|\bnicht von hand ändern\b|\bno editar\b|\bне редактировать\b"
    r"|\bimported unmodified from\b|\btaken from \w+ v?\d|\blocal copy, see upstream\b|\bvendored from\b"
    r"|\bsourcemappingurl=|^\W*\w+ build \d+\W*$|\| \(c\) [^\n|]*\| licen[sc]e",
    re.I | re.M,
)
PATHS = re.compile(
    r"(?:^|/)(?:gen|build|proto|dist|generated)/|(?:_generated|_pb2|\.gen|\.pb|\.g)\.\w+$|\.(?:min|bundle|umd)\.\w+$|-[0-9a-f]{6,}\.\w+$"
    r"|(?:^|/)(?:static|assets|public)/[^/]*\.\w+$|(?:^|/)(?:vendor|third_party|thirdparty|node_modules|deps|external|extern|godeps)/[^/]+/"
    r"|(?:^|/)fixtures/\w+_table\.\w+$|^data/",
    re.I,
)

#: Those of the paths that name a library's own folder.
LIBRARY_FOLDERS = re.compile(r"(?:^|/)(?:vendor|third_party|thirdparty|node_modules|deps|external|extern|godeps)/[^/]+/", re.I)

#: Comments and strings, whichever starts first: what looks like a comment inside a string is none.
_PARTS = re.compile(
    r"(?P<comment>/\*.*?\*/|(?<![:\w])//[^\n]*|^[ \t]*(?:\"{3}.*?\"{3}|'{3}.*?'{3})[ \t]*$|^[ \t]*#(?!include|define|if|end|pragma)[^\n]*|^--[^\n]*)"
    r"|\"{3}.*?\"{3}|'{3}.*?'{3}|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'",
    re.S | re.M,
)
_WORD = re.compile(r"\w+")
_SHAPE_WORD, _SHAPE_NUMBER = re.compile(r"[A-Za-z_]+"), re.compile(r"\d+")

FEATURES = (
    "compression", "entropy", "ident_mean", "ident_spread", "comment_density", "digits", "blanks", "line_mean", "line_longest",
    "line_repeats", "stem_repeats", "numbers", "longest_token", "long_share", "upstream",
)


def parted(code: str) -> tuple[str, list[str]]:
    """The code without its comments, and the comments."""
    comments: list[str] = []

    def take(m: re.Match) -> str:
        if m.lastgroup is None:
            return m.group()
        comments.append(m.group())
        return ""

    return _PARTS.sub(take, code), comments


def notice(code: str | None) -> bool:
    """Whether a comment says that the file was not written by hand here. Strings in the code don't count."""
    return bool(code) and any(map(NOTICES.search, parted(code)[1]))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return h


_hash = _Hashes()


def runs(words: list[str]) -> np.ndarray:
    """Distinct hashes of the runs of ``SHINGLE`` words, sorted."""
    n = len(words) - SHINGLE + 1
    if n < 1:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(_hash.__getitem__, words), np.uint64, len(words))
    out = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out.view(np.int64))


def _without(raw: bytes, signs: bytes) -> float:
    return (len(raw) - len(raw.translate(None, signs))) / max(1, len(raw))


def features(code: str) -> tuple[bool, list[float], np.ndarray]:
    """(whether the file has a notice, the values of ``FEATURES`` but the last, its runs of words).

    The longest line is left out of all but its own share where there are others: one long line, or a table in one
    line, doesn't make a file.
    """
    body, comments = parted(code)
    told = [c for c in comments if not NOTICES.search(c)]
    body = body.strip()
    kept = body or "".join(told)
    lines = [x for x in kept.split("\n") if x and not x.isspace()] or [""]
    longest = max(lines, key=len)
    long_share = len(longest) / max(1, sum(map(len, lines)))
    if len(lines) > 1:
        lines.remove(longest)
    kept = "\n".join(lines)
    raw = kept.encode("utf-8", "replace")
    words = _WORD.findall(kept)
    count = Counter(words)
    total = max(1, len(words))
    entropy = -sum(n * math.log2(n / total) for n in count.values()) / total / max(1.0, math.log2(total))
    named = {w: n for w, n in count.items() if not w[0].isdigit()}
    of = max(1, sum(named.values()))
    mean = sum(len(w) * n for w, n in named.items()) / of
    spread = math.sqrt(sum((len(w) - mean) ** 2 * n for w, n in named.items()) / of)
    shapes = set(_SHAPE_NUMBER.sub("9", _SHAPE_WORD.sub("a", kept)).split("\n"))
    commented = sum(map(len, told))
    lengths = [len(x) for x in lines]
    return len(told) < len(comments), [
        len(zlib.compress(raw, 6)) / max(1, len(raw)),
        entropy,
        mean,
        spread,
        commented / max(1, commented + len(body)),
        _without(raw, b"0123456789"),
        _without(raw, b" \t\r\n\v\f"),
        math.log1p(sum(lengths) / len(lines)),
        math.log1p(max(lengths)),
        1 - len(shapes) / len(lines),
        1 - len({w.rstrip("0123456789") for w in named}) / len(named) if named else 0.0,
        1 - sum(named.values()) / total,
        math.log1p(max(map(len, count), default=0)),
        long_share,
    ], runs(words)


def _overlap(shared, size):
    """Half a file out of a library makes it a copy, however much more; a quarter may."""
    return F.least(F.lit(2.0), F.floor(4 * shared / F.greatest(F.lit(1), size)).cast("double"))


def _measured(files: DataFrame, upstream: DataFrame) -> DataFrame:
    """(file_id, fold, blank, declared, label, measures): every file with code, with the values of ``FEATURES``.

    The library files' runs of words are broadcast if they are few; otherwise files' runs are joined to them by
    shuffle, which gives the same.
    """
    library_runs = pandas_udf(lambda codes: codes.map(lambda c: runs(_WORD.findall(parted(c)[0]))), "array<bigint>")
    known = upstream.where("code is not null").select(F.explode(library_runs("code")).alias("__run")).distinct()
    few = known.limit(MOST_RUNS + 1).count() <= MOST_RUNS
    held = files.sparkSession.sparkContext.broadcast(np.sort(known.toPandas()["__run"].to_numpy(np.int64))) if few else None

    @pandas_udf("struct<declared:boolean,label:double,measures:array<double>,size:int,shared:int,runs:array<bigint>>")
    def look(codes: pd.Series, paths: pd.Series) -> pd.DataFrame:
        out = []
        for code, path in zip(codes, paths):
            noticed, measures, own = features(code)
            declared = noticed or bool(path and LIBRARY_FOLDERS.search(path))
            label = float(declared or bool(path and PATHS.search(path)))
            if held is not None:
                at = np.searchsorted(held.value, own)
                shared = int((held.value[np.minimum(at, len(held.value) - 1)] == own).sum()) if len(held.value) else 0
                out.append((declared, label, measures, len(own), shared, []))
            else:
                out.append((declared, label, measures, len(own), 0, own))
        return pd.DataFrame(out, columns=["declared", "label", "measures", "size", "shared", "runs"])

    seen = files.where("code is not null").select(
        "file_id", F.pmod(F.xxhash64("code"), F.lit(FOLDS)).alias("fold"), (~F.col("code").rlike(r"\S")).alias("blank"), look("code", "path").alias("l")
    )
    if few:
        return seen.select("file_id", "fold", "blank", "l.declared", "l.label", F.concat("l.measures", F.array(_overlap(F.col("l.shared"), F.col("l.size")))).alias("measures"))
    seen = checkpointed(seen.select("*", F.xxhash64("l.runs").alias("__text")))
    # Files of equal runs are counted once, so a file that is copied a million times is one set of runs.
    alike = seen.select("__text", "l.runs").dropDuplicates(["__text"])
    shared = alike.select("__text", F.explode("runs").alias("__run")).join(known, "__run", "left_semi").groupBy("__text").agg(F.count(F.lit(1)).alias("__shared"))
    joined = seen.join(shared, "__text", "left")
    return joined.select("file_id", "fold", "blank", "l.declared", "l.label", F.concat("l.measures", F.array(_overlap(F.coalesce("__shared", F.lit(0)), F.col("l.size")))).alias("measures"))


def _sample(rows: DataFrame, label: float, n: int) -> DataFrame:
    """At most about ``MOST_ROWS`` of the ``n`` rows of a label, drawn by hash of the id, the same ones each time."""
    own = rows.where(F.col("label") == label)
    return own if n <= MOST_ROWS else own.where(F.pmod(F.xxhash64("file_id"), F.lit(1_000_000)) < int(1e6 * MOST_ROWS / n))


def judged(files: DataFrame, upstream: DataFrame) -> DataFrame:
    """(file_id, declared, score): whether a notice or a library's folder says that the file isn't hand-written, and the forest's score.

    Null code is left out, empty and blank code is scored 0. Repeated files are scored alike. Where no file
    or every file has a label, there is nothing to learn from and the score is the label.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    seen = _measured(files, upstream)
    base = checkpointed(seen.select("file_id", "fold", "blank", "declared", "label", (F.element_at("measures", -1) == 2.0).alias("copied"), array_to_vector("measures").alias("features")))
    sizes = {r.label: r.n for r in base.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return base.select("file_id", "declared", F.col("label").alias("score"))
    score = vector_to_array("probability")[1]
    # At most 2 x MOST_ROWS rows: a few partitions hold them.
    rows = checkpointed(_sample(base, 1.0, sizes[1.0]).unionByName(_sample(base, 0.0, sizes[0.0])).coalesce(4))
    n_positive, n_negative = (min(MOST_ROWS, sizes[x]) for x in (1.0, 0.0))
    # Leaves that hold a hundredth of the labelled rows can't single out the copies of one file.
    leaf = max(3, n_positive // 100)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, subsamplingRate=0.8, minInstancesPerNode=leaf, featureSubsetStrategy="0.7")
    doubt = max(0.5 * n_positive / max(1, n_positive + n_negative), 0.12)
    # Copies of one file share a fold, so no copy vouches for another when it is scored.
    scored = None
    for fold in range(FOLDS):
        rest, own = rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold)
        known_both = rest.select("label").distinct().count() == 2
        told = (forest.fit(rest).transform(own).withColumn("s", score) if known_both else own.withColumn("s", F.col("label"))).select(*rows.columns, "s")
        scored = told if scored is None else scored.unionByName(told)
    # A label on a file that is half out of a library needs no forest to confirm it.
    trusted = checkpointed(scored.where((F.col("label") == 1.0) == ((F.col("s") > doubt) | F.col("copied"))).drop("s"))
    final = forest.fit(trusted if trusted.select("label").distinct().count() == 2 else rows)
    return final.transform(base).select("file_id", "declared", F.when(F.col("blank"), 0.0).otherwise(score).alias("score"))


def not_hand_written(files: DataFrame, upstream: DataFrame, least: float = 0.5) -> DataFrame:
    """(file_id): files that are generated, minified, copied from libraries or mere data, by the forest or as declared."""
    return judged(files, upstream).where(F.col("declared") | (F.col("score") > least)).select("file_id").distinct()


def hand_written(files: DataFrame, upstream: DataFrame) -> DataFrame:
    """``files`` without those that are not hand-written and those without code."""
    return files.where("code is not null").join(not_hand_written(files, upstream), "file_id", "left_anti")
