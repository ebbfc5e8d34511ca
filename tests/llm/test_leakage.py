"""The pattern search against direct containment, and planted leaks."""

import random

from pyspark.sql import functions as F

from quernel.llm import leakage as L

WORDS = "harbour lantern quietly marble velvet thunder pocket orchard silver ribbon candle meadow anchor puzzle winter copper saddle window basket feather mirror".split()


def text(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(100)) for _ in range(n)) + "."


ITEMS = {i: text(i, 40) for i in range(20)}


def test_every_pattern_that_occurs_is_found():
    search = L.LeakSearch(ITEMS)
    rng = random.Random(1)
    for trial in range(60):
        picks = [L.fold(ITEMS[rng.randrange(20)]) for _ in range(3)]
        body = b"".join(p[rng.randrange(0, 60) : rng.randrange(60, 200)] + L.fold(text(1000 + trial, 5)) for p in picks)
        want = {(k, s, at) for k, item in search.items.items() for s in {*range(0, len(item) - L.LENGTH + 1, L.STEP), len(item) - L.LENGTH} for at in range(len(body)) if body.startswith(item[s : s + L.LENGTH], at)}
        assert {(k, s, at) for k, hits in search.occurrences(body).items() for at, s in hits} == want


def leaked(doc):
    return [k for k, _ in L.LeakSearch(ITEMS).leaked(doc)]


def test_an_exact_half_of_a_short_item_is_found():
    for seed in range(8):
        letters = random.Random(seed)
        for n in range(L.LENGTH, 2 * (L.LENGTH + L.STEP) + 1):
            item, half = "".join(letters.choice("bcdfghjkmnpqrstvwxz") for _ in range(n)), (n + 1) // 2
            search = L.LeakSearch({**ITEMS, 90: item})
            for start in range(n - half + 1):
                assert [k for k, _ in search.leaked("0" * 40 + item[start : start + half] + "1" * 40)] == [90], (n, start)
            assert search.leaked("0" * 40 + item[: half - 1] + "1" * 40) == []


def test_disguises():
    item = ITEMS[3]
    pad = text(99, 30)
    words = item.split(" ")
    for disguised in (
        item, item.upper(), "  ".join(words), "\n# ".join(" ".join(words[i : i + 6]) for i in range(0, 40, 6)), item.replace(" ", " <b>x</b> ".replace("x", "")), item.replace("a", "а").replace("o", "о"),
        "​".join(item), item.replace(" ", "&nbsp;"), " ".join(w if i % 9 else "replaced" for i, w in enumerate(words)), item[: len(item) * 6 // 10], item[len(item) * 4 // 10 :],
        " ".join(words[:12]) + ". " + pad + " " + " ".join(words[25:38]),
    ):
        assert leaked(pad + " " + disguised + " " + pad) == [3], disguised[:80]


def test_what_is_no_leak():
    words = ITEMS[3].split(" ")
    for harmless in (" ".join(words[:10]), " ".join(sorted(words)), " ".join(words[22:]) + " " + text(5, 20) + " x", " ".join(reversed(words))):
        shares = dict(L.LeakSearch(ITEMS, 0.0).leaked(harmless))
        assert shares.get(3, 0) < 0.5, harmless[:80]


def test_out_of_order_halves_do_not_add_up():
    words = ITEMS[3].split(" ")
    turned = " ".join(words[24:36]) + " " + text(777, 30) + " " + " ".join(words[2:14])
    assert leaked(turned) == []


def test_operator_edge_cases(spark):
    items = spark.createDataFrame([(i, "s", t) for i, t in ITEMS.items()] + [(50, "s", None), (51, "s", " !! "), (52, "s", "tiny words"), (53, "s", ITEMS[3])], "item_id long, suite string, text string")
    docs = spark.createDataFrame([(1, None), (2, ""), (3, ITEMS[3]), (4, ITEMS[3]), (5, "so TINY, words here"), (6, text(77, 20_000) + ITEMS[5])], "doc_id long, text string")
    docs = docs.withColumn("item_id", F.lit(7)).withColumn("share", F.lit(0)).withColumn("source", F.lit("s"))
    found = L.leaks(docs, items)
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(3, 3), (3, 53), (4, 3), (4, 53), (5, 52), (6, 5)]
    assert L.leak_report(found, docs, items).first().n_docs == 4
    assert L.leaks(docs.limit(0), items).count() == 0 and L.leaks(docs, items.limit(0)).count() == 0


def test_items_shorter_than_a_pattern_are_found_whole():
    items = {1: "Ünder oath!", 2: "abc", 3: "a blue moon rose", 4: "moon roseate"}
    search = L.LeakSearch(items)
    for text in ("She spoke UNDER oath and saw a blue  moon rose.", "moon", "xabcx", "the moon, roseate", ""):
        assert {k for k, _ in search.leaked(text)} == {k for k, t in items.items() if L.fold(t) in L.fold(text)}


def test_items_in_blocks(spark, monkeypatch):
    texts = [(i, f"The item number {i} tells of a thing called {'abcdefghij'[i % 10] * 9} in a far away place.") for i in range(40)]
    docs = spark.createDataFrame([(i, f"Before it. {t} After it.") for i, t in texts] + [(99, None)], "doc_id long, text string")
    items = spark.createDataFrame(texts, "item_id long, text string")
    want = sorted(map(tuple, L.leaks(docs, items).collect()))
    monkeypatch.setattr(L, "MOST_ITEMS", 15)
    assert want and sorted(map(tuple, L.leaks(docs, items).collect())) == want
