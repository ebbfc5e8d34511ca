"""Token counts against brute force and against a public tokenizer's own library."""

import base64
import os
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernel.llm import token_budget as tb

PIECES = ["a", "b", "ab", "abc", " a", " ab", "1", "12", "\n", "  ", "é", "日本"]


def brute(text, pieces):
    n, longest = 0, max(map(len, pieces))
    for p in re.findall(tb.PRE_SPLIT, text or ""):
        i = 0
        while i < len(p):
            k = next((k for k in range(longest, 0, -1) if i + k <= len(p) and p[i : i + k] in pieces), 0)
            n += 1 if k else len(p[i].encode())
            i += k or 1
    return n


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abcé1 2\n日本😀.", max_size=40), max_size=8))
def test_longest_match_is_brute_force(texts):
    table = tb.PieceTable(PIECES)
    pieces = [p for t in texts for p in re.findall(tb.PRE_SPLIT, t)]
    assert table.counts(pieces).tolist() == [brute(p, set(PIECES)) for p in pieces]


def _encoding():
    tiktoken = pytest.importorskip("tiktoken")
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, P.PATTERN, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_merges_agree_with_the_tokenizer(spark, data):
    path, pattern, encoding = _encoding()
    assert os.path.exists(path)
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.n_tokens for r in tb.with_token_counts(docs, tb.bpe_counter(spark, path, pattern)).select("doc_id", "n_tokens").collect()}
    assert got == {r.doc_id: len(encoding.encode_ordinary(r.text)) if r.text else 0 for r in docs.collect()}


def test_runs_of_equal_symbols_merge_from_the_left():
    path, _, encoding = _encoding()
    texts = ["a" * n for n in range(1, 40)] + ["ab" * 9, "\t" * 7, "é" * 5, "zzzz" * 300]
    assert tb.MergeTable.from_tiktoken(path).counts(texts).tolist() == [len(encoding.encode_ordinary(t)) for t in texts]


def test_nulls_empty_long_repeated_and_clashing_columns(spark):
    vocab = spark.createDataFrame([(p,) for p in PIECES] + [(None,), ("",), ("ab",)], "piece string")
    long = "abc " * 50_000
    rows = [(1, "s", None), (1, "s", ""), (1, "s", "abc ab"), (1, "s", "abc ab"), (None, None, "q"), (2, "s", long)]
    docs = spark.createDataFrame(rows, "shard_id long, source string, text string").withColumn("lang", F.lit(None).cast("string")).withColumn("n_tokens", F.lit(99)).withColumn("piece", F.lit("x"))
    counter = tb.vocabulary_counter(vocab)
    got = {(r.shard_id, r.source): (r.n_docs, r.n_tokens) for r in tb.token_totals(docs, counter, ["shard_id", "source", "lang"]).collect()}
    assert got == {(1, "s"): (4, 4), (None, None): (1, 1), (2, "s"): (1, brute(long, set(PIECES)))}
    slices = spark.createDataFrame([(1, "s", None, 4.0), (2, "s", None, 5.0), (None, None, None, 1.0), (3, "s", None, 0.0), (3, "t", None, 1.0), (4, "s", None, None)], "shard_id long, source string, lang string, actual_tokens double")
    wrong = tb.misreported_slices(slices, tb.token_totals(docs, counter, ["shard_id", "source", "lang"]))
    assert sorted((r.shard_id, r.source) for r in wrong.collect()) == [(2, "s"), (3, "t")]
    assert tb.token_totals(docs.limit(0), counter, ["lang"]).count() == 0


def test_the_tolerance_is_not_crossed_by_equality(spark):
    totals = spark.createDataFrame([(1, "s", "en", 100)], "shard_id long, source string, lang string, n_tokens long")
    for actual, wrong in ((115.0, 0), (115.5, 1), (85.0, 0), (84.0, 1)):
        slices = spark.createDataFrame([(1, "s", "en", actual)] * 2, "shard_id long, source string, lang string, actual_tokens double")
        assert tb.misreported_slices(slices, totals).count() == wrong


def test_a_vocabulary_that_grows_is_refused(spark, monkeypatch):
    monkeypatch.setattr(tb, "MOST_PIECES", 2)
    with pytest.raises(ValueError):
        tb.vocabulary_counter(spark.createDataFrame([("a",), ("b",), ("c",)], "piece string"))
