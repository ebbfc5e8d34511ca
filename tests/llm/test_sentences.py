"""Sentence ends in cases written out by hand: | marks each end."""

import pytest
from pyspark.sql import functions as F

from quernel.llm import sentences as S

CASES = [
    "He came at 3 p.m. sharp.| She left at 5 p.m.| The end.|",
    "Dr. Who met Mrs. Hill (see Fig. 8.3) on St. James St. today.| Yes.|",
    'He said, "The cat sat."| The dog ran.|',
    '"Is it late?" asked Ann.| "No!"| She left.|',
    '"Is it late?" Ann asked along the canal.| "It is late."| Bob replied, "Good."|',
    "It stopped ... well .... Then it went.|".replace(".... ", "....| "),
    "Steady, early, etc. In the end it fell.|".replace("etc. ", "etc.| "),
    "(It was late.)| We went home.|",
    "It costs 3.14 v1.2.3 at docs.a.example/x.html today.| Ok.|",
    "It was late 🙂| The next day came.|",
    "Lost the space.|Then it went on.|",
    "6.1 A heading\n\nThe text is\nwrapped here.| More.|".replace("heading\n", "heading|\n"),
    "Intro.|\n\n* one thing here\n- another i.e. Thing\n1. third.|".replace("here\n", "here|\n").replace("Thing\n", "Thing|\n"),
    "Am 12. Mai kam Nr. 18 gegen 8.30 Uhr z. B. an.| Im 3. Jahrhundert nicht.| Das war Seite 9.| Die Tür.|",
    "„Kommt er?“, fragte Anna.| „Nein!“| Er ging.|",
    "« Vient-il ? » demanda Anne.| « Non ! »| M. Dupont partit p. ex. Lundi.|",
    "¿Viene?| ¡No!| El Sr. López vino... Después salió.| —La carta llegó —dijo Ana.| Fin.|".replace("... ", "...| "),
    "Он родился в 1981 г. вчера, т. е. давно.| «Да», — сказал кот.| Вот и т. п. вещи.|",
    "昨天他来了。|“谁来了？”老师喊道。|他说：“没有人。”|“好！”|",
    "昨日来た。|「誰だ！」と言った。|「よし！」|早朝帰った（約5.9キロ）。|",
    "وصل د. سامي أمس.| هل جاء؟| نعم!|",
    "डॉ. राम आए।| क्या वे गए?| हाँ।|",
    "ครูลืมร่มเมื่อวาน| คุณยายพบจดหมาย จำนวน 75 ชิ้น| แมวเปิดกล่อง น้ำหนัก 69.2 กก.| นักเรียนซ่อมว่าวค่ะ| จบ|",
    "every word is small. it ends at 5 p.m. then it goes on. dr. who came.|".replace("small. ", "small.| ").replace("p.m. ", "p.m.| ").replace("on. ", "on.| "),
    "„Er kam. Sie ging“, sagte Anna.| „Nein. Ja“, rief er.| Ende.|",
    "She said: “It rained. We left.”| Then it was dark.| (Not now. Later.)| It ended.|",
    "“It rained. We left.| It snowed.| We came back.”| Then it was dark.|".replace("“It rained.", "“It rained.|"),
    "An “ opened here.| It never closes.| So it goes.|",
    "no terminator at all|",
    "  spaced   .|  \n ",
]


@pytest.mark.parametrize("marked", CASES)
def test_ends(marked):
    text, want = "", []
    for c in marked:
        if c == "|":
            want.append(len(text))
        else:
            text += c
    assert S.Splitter(["ร่ม", "ครู", "จดหมาย"]).ends(text) == want


def test_boundaries_come_from_the_lattices(monkeypatch):
    text, quote, thai = '"Is it late?" asked Ann. It rained.', "“谁来了？”老师喊道。", "คุณยายพบจดหมาย จำนวน 75 ชิ้น"
    assert [len(S.Splitter().ends(t)) for t in (text, quote, thai)] == [2, 1, 1]
    monkeypatch.setattr(S, "GOES_ON", 0.0)
    assert [len(S.Splitter().ends(t)) for t in (text, quote)] == [3, 2]
    splitter = S.Splitter()
    splitter.thai = S.WordLattice([])
    assert len(splitter.ends(thai)) == 2


def test_dictionaries_keep_particles_and_words_apart():
    text, final = "ทีมเราชนะ จำนวน 5 คน", "ไปกันเถอะนะ จำนวน 5 คน"  # to win ends like a final particle
    assert len(S.Splitter(["ชนะ", "ทีม", "เรา"]).ends(text)) == 1 and len(S.Splitter().ends(text)) == 2
    assert len(S.Splitter(["ชนะ", "ไป", "กัน", "เถอะ"]).ends(final)) == 2
    assert len(S.Splitter(["とても"]).ends("「好き！」とても好き。")) == 2 and len(S.Splitter().ends("「好き！」とても好き。")) == 1


def test_a_path_may_skip_any_number_of_terminators():
    inside = "Dr. No. vs. Mr. St. Fig. Eq. Prof. Ms. cf. e.g. Sr. " * 40
    assert S.Splitter().ends(f"It was {inside}Hill who came. Then it ended.") == [len(f"It was {inside}Hill who came."), len(f"It was {inside}Hill who came. Then it ended.")]


def test_word_lattice_takes_the_fewest_words():
    lattice = S.WordLattice(["เมื่อ", "เมื่อวาน", "วาน", "ครู"])
    assert lattice.split("ครูเมื่อวาน") == ["ครู", "เมื่อวาน"]
    assert lattice.split("") == [] and "".join(lattice.split("ครูxเมื่อ")) == "ครูxเมื่อ"


def test_operator_on_nulls_blanks_code_and_clashing_columns(spark):
    rows = [(1, "nlp", "A b. C d."), (2, None, "One."), (3, "code", "x. Y."), (4, "nlp", None), (5, "nlp", " \n "), (6, "nlp", ""), (7, "nlp", "A b. C d.")]
    docs = spark.createDataFrame(rows, "doc_id long, domain string, text string").withColumn("sent_end", F.lit(-1)).withColumn("sentence", F.lit("x"))
    got = sorted((r.doc_id, r.sent_end) for r in S.prose_sentence_ends(docs).collect())
    assert got == [(1, 4), (1, 9), (2, 4), (7, 4), (7, 9)]
    assert [r.sentence for r in S.prose_sentences(docs).where("doc_id = 1").orderBy("sent_no").collect()] == ["A b.", "C d."]
    assert S.prose_sentence_ends(docs.limit(0)).count() == 0


def test_sentences_cover_whole_texts(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").where("text is not null")
    for r in docs.collect():
        ends = S.Splitter().ends(r.text)
        assert ends == sorted(set(ends)) and (not r.text.strip() or ends[-1] == len(r.text.rstrip(" \t\r\n​")))
        assert all(not r.text[e - 1].isspace() for e in ends)


def test_long_texts_take_linear_time():
    text = "The cat sat. " * 40_000 + 'x."Y ' * 20_000 + "ครูลืม $x$ ร่ม " * 2_000
    assert len(S.Splitter().ends(text)) > 1
