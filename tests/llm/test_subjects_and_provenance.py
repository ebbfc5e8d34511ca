"""Held-out accuracy of the two trained operators, and their edge cases."""

import pathlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernel.llm import provenance as V
from quernel.llm import subjects as S


def test_units_and_terms():
    assert S.units("<domain:en>\nA cat sat. It ran far\naway.\nBP 1/2, HR 3\nBP 4/5, HR 6\n<|endofdoc|>") == ["A cat sat.", "It ran far away.", "BP 1/2, HR 3", "BP 4/5, HR 6"]
    assert S.terms("The x1 = 42 $ cat&") == ["the", "=", "$", "cat", "&"]


def corpus(spark, rows=240):
    """Three subjects with words of their own, general filler, rows of one or two subjects, and no label for most."""
    words = {"law": "court judge statute appeal verdict".split(), "music": "sonata chord tempo melody violin".split(), "sport": "goal referee match striker stadium".split(), "general": "table window garden street basket".split()}
    subjects = list(words)

    def sentence(s, k):
        w = words[s]
        return f"The {w[k % 5]} of the {w[(k * 3 + 1) % 5]} was near a {w[(k * 7 + 2) % 5]} again."

    out, truth = [], {}
    for i in range(rows):
        a, b = subjects[i % 4], subjects[(i // 4) % 3]
        own = [a] * 6 if i % 3 else [a] * 3 + [b] * 3
        out.append((i, "en" if i % 5 else None, " ".join(sentence(s, i * 11 + k) for k, s in enumerate(own))))
        truth[i] = {s for s in own if s != "general"} or {"general"}
    return spark.createDataFrame(out, "row_id long, lang string, text string"), truth, subjects


def test_subjects_on_unlabelled_rows(spark):
    texts, truth, subjects = corpus(spark)
    areas = spark.createDataFrame([(s,) for s in subjects] + [(None,)], "subject string")
    labels = spark.createDataFrame([(i, s) for i, t in truth.items() if i % 4 == 0 or i % 7 == 0 for s in t] + [(9999, "law"), (7, "nonsense"), (7, None)], "row_id long, subject string")
    extra = spark.createDataFrame([(1000, "en", None), (1001, "en", ""), (1002, None, " \n "), (1003, "xx", "zzz"), (1004, "en", "court " * 20_000)], "row_id long, lang string, text string")
    texts = texts.unionByName(extra).withColumn("subject", F.lit("x")).withColumn("leaf", F.lit(3)).withColumn("n", F.lit(3))
    got = {}
    for r in S.assigned_subjects(texts, areas, labels).collect():
        got.setdefault(r.row_id, set()).add(r.subject)
    assert not {1000, 1001, 1002} & set(got) and got[1003] == {"general"} and got[1004] == {"law"}
    held_out = [i for i in truth if i % 4 and i % 7]
    assert sum(got[i] == truth[i] for i in held_out) >= 0.9 * len(held_out)


def test_subjects_come_from_leaves(spark, monkeypatch):
    texts, truth, subjects = corpus(spark)
    areas = spark.createDataFrame([(s,) for s in subjects], "subject string")
    labels = spark.createDataFrame([(i, s) for i, t in truth.items() for s in t], "row_id long, subject string")
    monkeypatch.setattr(S, "label_leaves", lambda leaf_counts, subject_counts, otherwise: np.full(len(leaf_counts), otherwise))
    assert {r.subject for r in S.assigned_subjects(texts, areas, labels).collect()} == {"general"}


def test_subjects_by_languages_in_groups(spark, monkeypatch):
    texts, truth, subjects = corpus(spark, 120)
    twice = texts.where("lang is not null").unionByName(texts.where("lang is not null").withColumn("lang", F.lit("fr")).withColumn("row_id", F.col("row_id") + 1000))
    areas = spark.createDataFrame([(s,) for s in subjects], "subject string")
    labels = spark.createDataFrame([(i + x, s) for i, t in truth.items() for s in t for x in (0, 1000)], "row_id long, subject string")
    want = sorted(map(tuple, S.assigned_subjects(twice, areas, labels).collect()))
    monkeypatch.setattr(S, "LANGUAGES_AT_ONCE", 1)
    assert sorted(map(tuple, S.assigned_subjects(twice.repartition(7), areas, labels).collect())) == want


def test_subjects_of_nothing(spark):
    areas = spark.createDataFrame([("law",)], "subject string")
    labels = spark.createDataFrame([], "row_id long, subject string")
    assert S.assigned_subjects(spark.createDataFrame([], "row_id long, lang string, text string"), areas, labels).count() == 0
    few = spark.createDataFrame([(1, None, "court"), (2, None, "court")], "row_id long, lang string, text string")
    assert {(r.row_id, r.subject) for r in S.assigned_subjects(few, areas, labels).collect()} == {(1, "general"), (2, "general")}


@pytest.mark.parametrize("code,said", [
    ("# Code generated by tool 1.2. DO NOT EDIT.\nx = 1", True), ("/*\n * @generated\n */", True), ("// taken from lib 1.2.3", True), ("x = 1\n//# sourceMappingURL=x.map", True), ("/* Automatisch erzeugte Datei, bitte nicht von Hand ändern */", True),
    ("# The table used to be generated by a script, now Ann keeps it by hand.", False), ("# Do not edit the table while it runs.", False), ('T = "Code generated by x. DO NOT EDIT."', False), ("x = 1", False), ("", False), (None, False),
    ("T = '''// Code generated by x. DO NOT EDIT.\npackage y\n'''\n", False), ("def f():\n    '''@generated'''\n", True), ("x = 'a' # b\n# @generated", True),
])
def test_notices(code, said):
    assert V.notice(code) == said


@pytest.mark.parametrize("path,said", [
    ("gen/x.py", True), ("src/x_pb2.py", True), ("static/x.min.js", True), ("third_party/lib-1.2/x.c", True), ("a/node_modules/b/c.js", True), ("data/x.js", True), ("src/vendor/x.py", False), ("codegen/x.py", False), ("app/x.py", False),
])
def test_paths(path, said):
    assert bool(V.PATHS.search(path)) == said


def files(spark):
    hand = 'import a{0}\n\ndef f{0}(x, y):\n    """Does thing {0} for the caller."""\n    total = x * {0} + y\n    for item in range(total):\n        print(item, total)\n    return total\n\nclass C{0}:\n    name = "n{0}"\n\n    def run(self, other):\n        if other > {0}:\n            raise ValueError(other)\n        return self.name\n'
    table = "\n".join("    0x%02x, 0x%02x, 0x%02x, 0x%02x," % (i, (i * 7) % 256, (i * 13) % 256, (i * 29) % 256) for i in range(60))
    mini = "".join(f"var a{i}=b{i}||c;function d{i}(e){{return e.f({i})}};" for i in range(40))
    lib = "\n".join(f"int widget_{i}(struct gadget *g, int n) {{ return g->slots[n + {i}] * {i * 3}; }}" for i in range(30))
    # Hand-written code is this library's own, cut between functions: sixty pieces of many shapes.
    source = "\n".join(p.read_text() for p in sorted(pathlib.Path(V.__file__).parent.parent.rglob("*.py")))
    pieces = [x for x in source.split("\n\n\n") if len(x) > 300 and "QUERIES = {" not in x][:60]
    assert len(pieces) == 60
    rows = [(i, f"src/m{i}.py", piece) for i, piece in enumerate(pieces)]
    rows += [(100 + i, "gen/t.c", f"/* @generated */\nint g{i}[] = {{\n" + table + "\n};") for i in range(15)] + [(200 + i, "src/t.c", f"int t{i}[] = {{\n" + table + "\n};") for i in range(10)]
    rows += [(300 + i, "static/x.min.js", mini) for i in range(15)] + [(400 + i, "app/y.js", mini.replace("b", "q")) for i in range(10)]
    rows += [(500 + i, "third_party/w/w.c", lib) for i in range(10)] + [(600 + i, "src/w.c", lib.split("\n", 5)[5].replace("slots", "cells") if i % 2 else lib) for i in range(8)]
    rows += [(700, "src/n.py", None), (701, "src/e.py", ""), (702, "src/b.py", "  \n"), (703, None, hand.format(99)), (704, "src/long.py", source)]
    return spark.createDataFrame(rows, "file_id long, path string, code string").withColumn("label", F.lit("x")).withColumn("score", F.lit(1)), spark.createDataFrame([(lib,), (None,)], "code string")


def test_files_not_written_by_hand(spark):
    all_files, upstream = files(spark)
    got = {r.file_id for r in V.not_hand_written(all_files, upstream).collect()}
    assert got >= {*range(100, 115), *range(300, 315), *range(500, 510)}  # labelled
    unlabelled = {*range(200, 210), *range(400, 410), *range(600, 608)}
    assert len(got & unlabelled) >= 0.9 * len(unlabelled)
    assert len(got & {*range(60)}) <= 3  # held-out accuracy of 0.95 on so small a sample
    assert not got & {700, 701, 702}  # null is left out, empty and blank code is no case; the long file 704 is only scored
    kept = V.hand_written(all_files, upstream)
    assert kept.count() == all_files.count() - len(got) - 1 and set(kept.columns) == set(all_files.columns)


def test_library_runs_by_shuffle_and_by_broadcast(spark, monkeypatch):
    all_files, upstream = files(spark)
    want = sorted(map(str, V._measured(all_files, upstream).collect()))
    monkeypatch.setattr(V, "MOST_RUNS", 0)
    assert sorted(map(str, V._measured(all_files, upstream).collect())) == want


def test_of_paths_only_library_folders_declare(spark):
    all_files, upstream = files(spark)
    moved = all_files.withColumn("path", F.when(F.col("file_id") == 3, "build/m.py").when(F.col("file_id") == 5, "third_party/lib-1.2/m.py").otherwise(F.col("path")))
    got = {r.file_id for r in V.not_hand_written(moved, upstream).collect()}
    assert 3 not in got and 5 in got


def test_files_all_alike(spark):
    all_files, upstream = files(spark)
    assert V.not_hand_written(all_files.limit(0), upstream).count() == 0
    assert V.not_hand_written(all_files.where("file_id < 60"), upstream.limit(0)).count() == 0
    assert V.not_hand_written(all_files.where("file_id between 100 and 114"), upstream).count() == 15
