"""Hand-computed cases."""

import math

import pytest
from pyspark.sql import functions as F

from quernel.functions import classify as C
from quernel.functions import metrics as M
from quernel.functions import ordering as H
from quernel.functions import text as T
from quernel.operators import compose, evaluation, packing, quality, results, sampling, series, vectors
from quernel.plans.scan import neighbour, prefix_sum
from quernel.queries.corpus import QUERIES as CORPUS
from quernel.queries.tokens import QUERIES as TOKENS
from quernel.session import bounded_rows
from quernel.sources import readers


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_prefix_sum_is_the_same_however_it_is_bucketed(spark):
    df = spark.createDataFrame([("a" if i % 3 else "b", i, i * i % 7) for i in range(60)] + [("c", 1, None)], "k string, i int, v int")
    for width in (1, 7, 100):
        got = {(r.k, r.i): r.s for r in prefix_sum(df, ["k"], [F.col("i")], "v", "s", F.floor(F.col("i") / width).cast("int")).collect()}
        for k in "abc":
            total = 0
            for r in sorted((r for r in df.collect() if r.k == k), key=lambda r: r.i):
                assert got[k, r.i] == total
                total += r.v or 0


def test_budget_trim_keeps_the_row_that_crosses(spark):
    df = spark.createDataFrame([("a", 4), ("b", 3), ("c", 5), ("d", 1)], "w string, n int")
    order = [r.w for r in df.withColumn("h", H.hash_of("s", F.col("w"))).orderBy("h").collect()]
    for target in (0, 7, 8, 100):
        kept = {r.w for r in H.budget_trim(df, "n", F.lit(target), "s", "w", []).collect()}
        want, total = set(), 0
        for w in order:
            if total < target:
                want.add(w)
            total += {"a": 4, "b": 3, "c": 5, "d": 1}[w]
        assert kept == want


@pytest.mark.parametrize("n,val", [(5, 1), (20, 1), (39, 1), (40, 2), (1000, 50)])
def test_split_sizes(spark, n, val):
    parts = sampling.split(spark.range(n), "id", 0.05, "s").groupBy("part").count().collect()
    assert {r.part: r["count"] for r in parts}["val"] == val


def test_round_robin(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 0, 2), ("a", 0, 3), ("b", 1, 4), ("c", 2, 5), ("c", 2, 6)], "s string, o int, v int")
    assert [r.v for r in sampling.round_robin(df, "s", "o", "v").orderBy("seq").collect()] == [1, 4, 5, 2, 6, 3]


def test_packing_drops_the_rest(spark):
    df = spark.createDataFrame([(1, [100, 101, 102]), (2, [200, 201, 202, 203]), (3, [300, 301, 302, 303, 304]), (4, None), (5, [])], "d int, items array<int>")
    got = packing.packed(df.withColumn("s", F.lit("x")), ["s"], F.col("d"), "items", 5, F.lit(0)).orderBy("chunk_id").collect()
    assert [r["items"] for r in got] == [[100, 101, 102, 200, 201], [202, 203, 300, 301, 302]]


def test_routed_windows_and_targets(spark):
    spans = spark.createDataFrame([(1, "A", 0, ["3", "4"]), (2, "B", 1, ["7", "8", "9"]), (3, "A", 0, ["5"])], "p int, d string, i int, t array<string>")
    items = spans.select("p", F.lit("s").alias("s"), packing.routed_items(F.col("i").cast("string"), F.col("t"), F.col("d"), F.col("i")).alias("items"))
    windows = packing.packed(items, ["s"], F.col("p"), "items", 4, F.lit(0))
    vocab = {0: 10, 1: 20}
    told = packing.with_targets(windows, "items", lambda x, y: F.when(y["is_control"], F.when(x["domain_index"] == 0, vocab[0]).otherwise(vocab[1]) + y["domain_index"]).otherwise(y["token"].cast("int")))
    got = told.orderBy("chunk_id").collect()
    assert [[x.token for x in r["items"]][:3] for r in got] == [["0", "3", "4"], ["7", "8", "9"]]
    assert [r.targets for r in got] == [[3, 4, 11], [8, 9, 20]]


def test_span_parse_drops_what_comes_before_the_first_tag(spark):
    df = spark.createDataFrame([(1, "junk<domain:en>\nhello w\n<domain:de>\nguten tag\n"), (2, "<domain:en>\nhello\n<domain:de>\nguten tag\n"), (3, None), (4, "none")], "k int, text string")
    got = {(r.k, r.span_pos, r.domain, r.body) for r in compose.parsed_spans(df, "k").collect()}
    assert {x for x in got if x[0] == 2} == {(2, 0, "en", "hello"), (2, 1, "de", "guten tag\n")}
    assert not [x for x in got if x[0] > 2]


@pytest.mark.parametrize("text,hit", [
    ("Shane saw the red barn and Shane left", True), ("Shane Shane saw the barn", False), ("about it was said again about now", False), ("Shane is Shane", False),
])
def test_copy_structure(spark, text, hit):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert bool(quality.copy_structured(df, least_letters=5, least_gap=3).count()) == hit


def test_smooth_and_downsample(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate((4.0, 2.0, 6.0, 8.0))], "k int, i int, v double")
    got = [round(r.s, 4) for r in series.smoothed(df, ["k"], ["i"], "v", 1, "s").orderBy("i").collect()]
    assert got == [3.0, 4.0, 5.3333, 7.0]
    for n, k, want in ((10, 4, [0, 3, 6, 9]), (12, 5, [0, 3, 6, 8, 11]), (8, 3, [0, 4, 7])):
        rows = spark.range(n).withColumn("k", F.lit(0))
        assert [r.id for r in series.downsampled(rows, ["k"], ["id"], k).orderBy("id").collect()] == want


def test_folds(spark):
    df = spark.createDataFrame([(0, 1, 1.0), (0, 2, 2.0), (0, 3, 4.0), (1, 1, 5.0)], "k int, i int, v double")
    assert {r.k: round(r.ema, 4) for r in series.ema(df, ["k"], ["i"], "v", 0.98).collect()} == {0: 1.0796, 1: 5.0}
    spikes = spark.createDataFrame([(0, i, 1.0) for i in range(30)] + [(0, 30, 9.0), (0, 31, float("nan")), (0, 32, None)], "k int, i int, v double")
    got = series.controlled(spikes, ["k"], ["i"], "v").first()
    assert got.skipped == 3 and 0.1 <= got.scale <= 3.0


def test_metric_functions(spark):
    assert one(spark, M.bits_per_byte(F.col("a"), F.lit(50)), a=100 * math.log(2)) == pytest.approx(2.0)
    assert one(spark, M.perplexity(F.col("a"), F.lit(3)), a=6.0) == pytest.approx(7.389056)
    z = F.array(F.lit(2.0), F.lit(1.0), F.lit(0.0))
    ce = one(spark, M.cross_entropy(z, F.lit(0)), a=1)
    assert ce == pytest.approx(0.407606, abs=1e-6)
    assert one(spark, M.focal(F.lit(ce)), a=1) == pytest.approx(0.045678, abs=1e-6)
    assert one(spark, M.margin(F.array(F.lit(1.0), F.lit(0.8)), F.lit(0)), a=1) == pytest.approx(0.3)
    for step, lr in ((0, 0), (250, 0.5), (500, 1), (10250, 0.5), (20000, 0)):
        assert one(spark, M.warm_cosine(F.col("a"), 500, 20000), a=step) == pytest.approx(lr)


def test_calibration(spark):
    df = spark.createDataFrame([("d", 0.95, True), ("d", 0.91, False), ("d", 0.15, False), ("d", 0.55, True)], "domain string, confidence double, correct boolean")
    assert evaluation.calibration_error(df).first().ece == pytest.approx(0.365)


@pytest.mark.parametrize("text,name,counts", [
    ("import os\nclass A:\n    def f(self): return x\nfor(;;){ print(x); y -> z; a::b => c; }\n", "code", [5, 4]),
    ("Theorem: $x^2$ and $\\alpha_1$; \\frac{a}{b} \\[ \\sum \\] lemma éproof proofé proof. matrix", "math", [5, 4]),
    ("We show (Smith et al.) hypothesis; p < 0.05 table 3 figure 12 doi:10.1 doi: 10 experimental arXiv abstracté", "science", [8]),
    ("Officials said on Monday at 10:30 pm, according to a spokesperson; reported. FRIDAYé friday", "nlp_news", [8]),
    ("I think we should go; imo I love it. shouldn't he? honestly, i feel. should élan", "nlp_opinion", [8]),
    ('"Go home now!" she said. He walked. "Étoile brille." élève he looked "No." "Abcd efg?"', "nlp_narrative", [5]),
    ("A cat is a pet. X refers to Y, is the one; is one of is used to", "nlp_reference", [5]),
])
def test_pattern_hits(spark, text, name, counts):
    label = next(x for x in C.DOMAINS + C.REGISTERS if x.name == name)
    assert [one(spark, C.hits(F.col("a"), C.Label("x", (p,))), a=text) for p in label.patterns] == counts


@pytest.mark.parametrize("text,label", [
    ("-> => ::", "nlp"), ("-> => :: ->", "code"), ("-> => :: -> lemma proof matrix axiom", "code"), ("lemma proof matrix", "nlp"), ("lemma proof matrix axiom arxiv abstract hypothesis doi:1", "math"), ("arxiv abstract hypothesis methodology", "science"), ("  ", "nlp"), (None, "nlp"),
])
def test_domain_classifier(spark, text, label):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(C.classified(F.col("t"), C.DOMAINS, F.lit("nlp"), 2000, 4).alias("x")).first().x == label


def test_classifiers_read_whole_texts(spark, tmp_path):
    late = "word " * 500 + "arxiv abstract hypothesis methodology according to officials"
    spark.createDataFrame([(1, "a", late), (2, "a", "word " * 500), (3, "b", None)], "doc_id long, domain string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {n: {r.doc_id: r.label for r in CORPUS[n][0](spark, str(tmp_path)).collect()} for n in ("s5_whole_texts", "c1_whole_texts", "c2_whole_texts", "c3_whole_texts")}
    assert found["s5_whole_texts"] == {1: "science"} and found["c1_whole_texts"] == {1: "science", 2: "nlp", 3: "nlp"}
    assert found["c2_whole_texts"][1] == "nlp_news" and found["c3_whole_texts"][1] == "science"
    assert {tuple(r) for r in CORPUS["c4_whole_texts"][0](spark, str(tmp_path)).collect()} == {("a", "science", 1), ("a", "nlp", 1), ("b", "nlp", 1)}


def test_bytes_per_token_of_all_documents(spark, tmp_path):
    spark.createDataFrame([(i, "a", "ab cd" if i % 2 else "abcd") for i in range(400)] + [(400, "b", " "), (401, None, "x")], "doc_id long, domain string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = round((200 * 5 + 200 * 4) / 600, 6)
    assert [tuple(r) for r in TOKENS["a9_all_documents"][0](spark, str(tmp_path)).collect()] == [("a", want, 400)]
    assert [tuple(r) for r in TOKENS["a10_all_documents"][0](spark, str(tmp_path)).collect()] == [(want, 400)]


def test_text_functions(spark):
    assert one(spark, T.snippet(F.col("a"), 2), a=" one  two\nthree") == "one two"
    assert one(spark, T.strip_signs(F.col("a")), a='"Hello!"') == "Hello"
    assert one(spark, T.html_escaped(F.col("a")), a="<a & 'b'>") == "&lt;a &amp; &#x27;b&#x27;&gt;"
    assert one(spark, T.canonical_piece(F.col("a")), a="▁The_ ") == "the"


def test_readers_and_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "en", "a\nb"), (2, "de", "c"), (3, "en", "<b>")], "doc_id long, domain string, text string")
    readers.write_tagged(df, str(tmp_path / "tagged"))
    assert sorted((r.domain, r.body.strip()) for r in readers.read_tagged(spark, str(tmp_path / "tagged")).collect()) == [("de", "c"), ("en", "<b>"), ("en", "a\nb")]
    readers.write_json_cache(df, str(tmp_path / "json"))
    (tmp_path / "json" / "bad.json").write_text('{"text": "ok"}\n{broken\n{"text": "  "}\n\n')
    assert sorted(r.text for r in readers.read_json_cache(spark, str(tmp_path / "json")).collect()) == ["<b>", "a\nb", "c", "ok"]
    df.write.parquet(str(tmp_path / "p"))
    assert readers.read_documents(spark, str(tmp_path / "p")).columns == ["doc_id", "domain", "side", "source", "text"]
    assert readers.read_if_there(spark, str(tmp_path / "none")).count() == 0 and readers.read_if_there(spark, str(tmp_path / "p")).count() == 3


def test_lines_by_their_offsets(spark, tmp_path):
    df = spark.createDataFrame([(f"line {i} é" * (i % 3 + 1),) for i in range(50)] + [("",)], "text string")
    df.repartition(3).write.text(str(tmp_path / "t"))
    places = readers.line_offsets(spark, f"file://{tmp_path}/t")
    assert places.count() == 51 and places.where("offset = 0").count() == 3
    assert sorted(r.line for r in readers.lines_at(places).collect()) == sorted(r.text for r in df.collect())
    some = places.where("offset % 2 = 0").repartition(5)
    got = {(r.path, r.offset): r.line for r in readers.lines_at(some).collect()}
    assert len(got) == some.count() and all(len(got[r.path, r.offset].encode()) == r.length for r in some.collect())
    assert readers.lines_at(places.limit(0)).count() == 0


def test_a_cache_comes_before_its_source(spark, tmp_path):
    opened = []

    def source():
        opened.append(1)
        return spark.createDataFrame([("from the source",)], "text string")

    cache = str(tmp_path / "cache")
    assert readers.cached_or(spark, cache, source).first().text == "from the source"
    readers.write_json_cache(spark.createDataFrame([("from the cache",)], "text string"), cache)
    assert readers.cached_or(spark, cache, source).first().text == "from the cache" and len(opened) == 1


def test_copy_words_in_rows(spark):
    from quernel.operators import quality

    filler = " ".join(f"w{i}" for i in range(20)).replace("w", "x")
    rows = [(1, f"Harbour {filler} harbour"), (2, f"harbour harbour {filler}"), (3, None), (4, ""), (1, f"Harbour {filler} harbour"), (5, f"about {filler} about ship {filler} ship")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("x"))
    assert sorted(map(tuple, quality.copy_words(df).collect())) == [(1, "harbour"), (1, "harbour")]
    assert sorted(r.doc_id for r in quality.copy_structured(df).collect()) == [1, 1]


def test_retries():
    waits, tries = [], []

    def open_():
        tries.append(1)
        if len(tries) < 4:
            raise OSError("429")
        return "frame"

    assert readers.opened(open_, lambda e: "429" in str(e), waits.append) == "frame"
    assert waits == [5, 10, 20] and readers.retry_delays() == [5, 10, 20, 40, 80, 90]
    with pytest.raises(OSError):
        readers.opened(lambda: (_ for _ in ()).throw(OSError("404")), lambda e: "429" in str(e), waits.append)


def test_store_and_vectors(spark):
    store = spark.createDataFrame([("a", 1, 2.0), ("b", 2, None)], "arm string, step int, loss double")
    new = spark.createDataFrame([("b", 3, None), ("c", 4, 1.0)], "arm string, step int, loss double")
    assert sorted(map(tuple, results.merged(store, new, ["arm"]).collect())) == [("a", 1, 2.0), ("b", 3, None), ("c", 4, 1.0)]
    assert sorted(map(tuple, results.upserted(store, new, ["arm"]).select("arm", "step").collect())) == [("a", 1), ("b", 3), ("c", 4)]
    v = spark.createDataFrame([(0, 0, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 1, [1.0, 0.0]), (3, 1, [0.0, 1.0]), (4, 1, None)], "vec_id long, label int, embedding array<double>")
    assert [(r.vec_id, r.other_id) for r in vectors.nearest(v, v.where("vec_id = 0"), 2).orderBy("other_id").collect()] == [(0, 1), (0, 2)]
    with pytest.raises(Exception, match="differ in keys"):
        vectors.averaged(v, v.where("vec_id < 2"), "vec_id", "embedding", 0.5).collect()


def test_bounded_rows_refuse_what_grows(spark):
    assert len(bounded_rows(spark.range(5), 5, "the rows")) == 5
    with pytest.raises(ValueError):
        bounded_rows(spark.range(6), 5, "the rows")


def test_neighbours_cross_buckets(spark):
    rows = [("a", i, None if i % 5 == 0 else i * 10) for i in range(0, 60, 3)] + [("b", 7, 1), (None, 1, 2), (None, 50, 3)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    for width in (1, 4, 1000):
        for ahead in (False, True):
            got = {(r.k, r.i): r.o for r in neighbour(df, ["k"], [F.col("i")], "v", "o", F.floor(F.col("i") / width).cast("int"), ahead).collect()}
            for k in ("a", "b", None):
                own = sorted(r for r in rows if r[0] == k)
                own = own[::-1] if ahead else own
                assert [got[k, r[1]] for r in own] == [None, *[r[2] for r in own[:-1]]]


def test_codec_round_trip(spark, data):
    from quernel.functions.bpe import bpe_codec

    public = pytest.importorskip("public_tokenizers")
    encode, decode = bpe_codec(spark, public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    docs = spark.read.parquet(f"{data}/documents.parquet").select("text").withColumn("ids", encode("text"))
    assert docs.where(~decode("ids").eqNullSafe(F.col("text"))).count() == 0
    assert docs.where("text is not null and text <> '' and size(ids) = 0").count() == 0


def test_command_line(spark, data, tmp_path, capsys):
    from quernel.__main__ import main

    main(["list"])
    assert "a8_compression_report" in capsys.readouterr().out.split()
    main(["run", "a29_largest_step", data, "--out", str(tmp_path / "o")])
    assert spark.read.parquet(str(tmp_path / "o")).columns == ["arm", "step"]


def test_the_library_stands_without_the_llm_subpackage():
    import pathlib

    root = pathlib.Path(__file__).resolve().parent.parent / "quernel"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "quernel.llm" not in path.read_text(), path
