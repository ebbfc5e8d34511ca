"""Statements and findings in cases written out by hand, and the automaton against direct search."""

import random

import pytest
from pyspark.sql import functions as F

from quernel.llm import licences as L


@pytest.fixture(scope="module")
def templates(spark, data):
    return {r.license_id: r.body for r in spark.read.parquet(f"{data}/license_ref.parquet").collect()}


@pytest.fixture(scope="module")
def reader(templates):
    return L.LicenceReader(templates)


def test_maximal_matches_are_those_of_direct_search(templates):
    automaton = L.TemplateAutomaton(templates)
    bodies = {k: L._WORD.findall(b.lower()) for k, b in templates.items()}
    grams = {tuple(b[i : i + n]) for b in bodies.values() for n in range(1, 12) for i in range(len(b) - n + 1)}
    rng = random.Random(3)
    for _ in range(200):
        words = []
        for _ in range(4):
            b = bodies[rng.choice(list(bodies))]
            i = rng.randrange(len(b))
            words += b[i : i + rng.randrange(1, 11)] + ["zzz"] * rng.randrange(2)
        words = words[:60]
        for end, size, state in automaton.matches(words):
            run = tuple(words[end - size : end])
            if size <= 11:
                assert run in grams
                assert size == 11 or end == len(words) or run + (words[end],) not in grams
            for key, at in automaton.ends[state]:
                assert bodies[key][at + 1 - size : at + 1] == list(run)


def test_chains_hold_over_a_phrase_that_a_template_repeats():
    first, last = [f"a{i}" for i in range(400)], [f"z{i}" for i in range(400)]
    again = " ".join(f"of the licence u{i}" for i in range(150))
    automaton = L.TemplateAutomaton({"long": f"{' '.join(first)} q of the licence r {' '.join(last)} {again}"})
    words = [*first, "x", "of", "the", "licence", "y", *last]
    assert [(k, a, b) for k, a, b, _ in automaton.located(words)] == [("long", 0, len(words))]


@pytest.mark.parametrize("name,want", [
    ("MIT", "mit"), (" mit", "mit"), ("The MIT licence", "mit"), ("Expat", "mit"), ("Apache License, Version 2.0", "apache-2.0"), ("apache_2.0", "apache-2.0"), ("ASL 2.0", "apache-2.0"), ("New BSD License", "bsd-3-clause"),
    ("FreeBSD-style licence", "bsd-2-clause"), ("GNU Lesser General Public License v2.1", "lgpl-2.1"), ("GNU Affero General Public License v3", "agpl-3.0"), ("GNU GPL, version 3", "gpl-3.0"), ("GPLv2", "gpl-2.0"),
    ("GPL-2.0-or-later", "gpl-2.0"), ("gpl-3.0-only", "gpl-3.0"), ("MPL 2", "mpl-2.0"), ("public-domain dedication (Unlicense)", "unlicense"), ("Internet-consortium licence", "isc"), ("mit or apache-2.0", "apache-2.0|mit"),
    ("NOASSERTION", None), ("see file", None), ("n/a", None), ("", None), (None, None), ("permit", None), ("mitigated", None), ("gpl-4.0", None),
])
def test_fields(reader, name, want):
    assert ["|".join(sorted(s)) for s in reader.field(name)] == ([want] if want else [])


@pytest.mark.parametrize("code,want", [
    ("# SPDX-License-Identifier: MIT OR GPL-2.0-only\nx = 1", "gpl-2.0 OR mit"), ("/*\n * Licensed under the GNU GPL, version 3.\n */", "gpl-3.0"), ('"""License: Apache-2.0"""', "apache-2.0"), ("// x v1.2 | (c) A B | License: ISC", "isc"),
    ("# Available under the MIT License or, at your option, the GPLv2.", "gpl-2.0 OR mit"), ("# Checks that every file carries an MIT or ISC tag", "unknown"), ("HELP = {'mit': 'short', 'gpl-3.0': 'long'}", "unknown"),
    ("# TODO ask which licence the files have.", "unknown"), ("# SPDX-License-Identifier: Proprietary", "unknown"), ("# License: MIT\n# SPDX-License-Identifier: ISC", "conflict"), ("", "unknown"), (None, "unknown"),
])
def test_code(reader, code, want):
    assert L.allowed(reader.code(code)) == want


def test_wording(reader, templates):
    for key, body in templates.items():
        words = body.split()
        for worded in (body, body.upper(), "// " + "\n// ".join(" ".join(words[i : i + 7]) for i in range(0, len(words), 7)), "Copyright X\n\n" + " ".join(words[: len(words) * 4 // 5]) + "\n\nEND", body.replace("program", "tool")):
            assert L.allowed(reader.text(worded)) == key
            assert L.allowed(reader.code("# " + worded.replace("\n", "\n# "))) == key
        assert L.allowed(reader.text(" ".join(words[: len(words) // 5]))) == "unknown"  # partial cover is rejected
    both = f"Take this work under either the MIT License or the ISC License, as you prefer. {templates['mit']}\n\n-- or --\n\n{templates['isc']}"
    assert L.allowed(reader.text(both)) == "isc OR mit"
    assert L.allowed(reader.text(templates["mit"] + "\n\n" + templates["isc"])) == "conflict"
    shared = "You may share and change this program, and whatever you build out of it must be shared on the same terms with its source."
    assert L.allowed(reader.text(shared)) == "unknown"  # two siblings fit equally well


def test_findings(spark, templates):
    refs = spark.createDataFrame(list(templates.items()), "license_id string, body string")
    repos = spark.createDataFrame([(1, "mit", None), (2, "other", "Dual-licensed: MIT OR GPLv2 (your choice)."), (3, "isc", "This project is released under the MIT License."), (4, None, None), (1, "mit", None)], "repo_id long, license string, license_text string").withColumn("finding", F.lit("x"))
    files = spark.createDataFrame(
        [(1, 1, "MIT", "x = 1"), (2, 1, None, None), (3, 2, "gpl-2.0", ""), (4, 2, None, "x"), (5, 3, None, "x"), (6, None, "isc", "x"), (7, 99, None, "# License: MIT"), (8, 4, None, None), (9, 1, "isc", "x"), (1, 1, "MIT", "x = 1")],
        "file_id long, repo_id long, license string, code string",
    ).withColumn("item_id", F.lit(0)).withColumn("license_text", F.lit("GPLv3"))
    got = sorted((r.item_kind, r.item_id, r.finding) for r in L.findings(files, repos, refs).collect())
    assert got == [
        ("file", 1, "mit"), ("file", 1, "mit"), ("file", 2, "mit"), ("file", 3, "gpl-2.0"), ("file", 4, "gpl-2.0 OR mit"), ("file", 5, "conflict"), ("file", 6, "isc"), ("file", 7, "mit"), ("file", 8, "unknown"), ("file", 9, "conflict"),
        ("repo", 1, "mit"), ("repo", 1, "mit"), ("repo", 2, "gpl-2.0 OR mit"), ("repo", 3, "conflict"), ("repo", 4, "unknown"),
    ]
    assert L.findings(files.limit(0), repos.limit(0), refs).count() == 0
    assert {r.finding for r in L.findings(files, repos, refs.limit(0)).collect()} == {"unknown"}


def test_a_licence_beyond_the_known_ones_is_named_by_its_id(templates):
    body = "Whoever runs this tool in a lighthouse shall wave at passing ships, keep the lamp clean, and leave these lines in every copy they make of it."
    reader = L.LicenceReader({**templates, "epl-2.0": "", "lighthouse-1.1": body, "zlib": ""})
    for text in ("EPL-2.0", "Eclipse Public License v2", "the Eclipse Public License, version 2.0", "epl 2.0"):
        assert reader.field(text) == [frozenset(["epl-2.0"])], text
    assert reader.field("EPL-1.0") == [] and reader.field("Lighthouse License v1.1") == [frozenset(["lighthouse-1.1"])]
    assert reader.code("// Licensed under zlib or the MIT License.\nint x;") == [frozenset(["zlib", "mit"])]
    assert reader.code("/* " + body.replace("passing", "all").replace(", ", "\n * ") + " */") == [frozenset(["lighthouse-1.1"])]


def test_more_statements_than_any_cap(spark):
    many = [(i, 1, "mit", None) for i in range(3)]
    repos = spark.createDataFrame([(1, f"{a} or {b}", None) for a in ("mit", "isc") for b in ("zlib", "unlicense") for _ in range(20)], "repo_id long, license string, license_text string")
    files = spark.createDataFrame(many, "file_id long, repo_id long, license string, code string")
    refs = spark.createDataFrame([(x, None) for x in ("mit", "isc", "zlib", "unlicense")], "license_id string, body string")
    assert {r.finding for r in L.findings(files, repos, refs).where("item_kind = 'file'").collect()} == {"conflict"}
