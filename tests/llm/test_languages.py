import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import languages as G

SAID = {
    "vi": "sinh viên đăng ký học phần tại phòng đào tạo trước ngày thi và nộp giấy tờ cho nhà trường theo quy định của khoa".split(),
    "en": "students register for the course at the office before the date of exams and hand in papers according to school rules".split(),
    "fr": "les étudiants doivent déposer le dossier au bureau avant la date des examens selon le règlement de cette école".split(),
    "de": "die studierenden melden sich vor der prüfung im büro an und geben ihre unterlagen nach den regeln der schule ab".split(),
    "es": "los estudiantes deben entregar los papeles en la oficina antes del examen según las normas de esta escuela".split(),
    "pt": "os estudantes devem entregar os papéis na secretaria antes do exame segundo as regras desta escola não".split(),
}


def sentence(lang, n=10):
    return " ".join(random.choice(SAID[lang]) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def trained(spark):
    random.seed(8)
    rows = []
    for i in range(360):
        lang = G.LANGS[i % 6]
        label = random.choice(G.LANGS) if i % 15 == 0 else lang
        rows.append((i, " ".join(sentence(lang) for _ in range(4)), label))
    return G.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_held_out_accuracy(trained):
    random.seed(9)
    y = [random.randrange(6) for _ in range(600)]
    x = [sentence(G.LANGS[k], 7).rstrip(".").lower().split() for k in y]
    assert (trained.scores(x).argmax(1) == np.array(y)).mean() > 0.97
    bare = [[G.bare(w) for w in s] for s in x]
    assert (trained.scores(bare).argmax(1) == np.array(y)).mean() > 0.93


def test_labels(spark):
    df = spark.createDataFrame([(x,) for x in ("vi", "VIE", "vi-VN", "vi_VN", " Tiếng Việt ", "English", "en-GB", "zh-Hant-TW", "italian", "xx", "und", "unknown", "", None, "pt-BR", "Français", "deu")], "l string")
    assert [r[0] for r in df.select(G.label(F.col("l"))).collect()] == ["vi", "vi", "vi", "vi", "vi", "en", "en", "other", "other", None, None, None, None, None, "pt", "fr", "de"]


def test_cases(spark, trained):
    random.seed(10)
    text = lambda lang, n=6: " ".join(sentence(lang) for _ in range(n))
    rows = [(1, text("vi"), "vi"), (2, text("vi"), "en"), (3, text("fr"), None), (4, text("vi") + "\n" + text("en"), "vi"), (5, text("de", 20) + "\n" + text("en", 1), "de"), (6, "ok", None), (7, None, None), (8, "", "xx"), (9, "1234 5678 " * 20, None), (10, text("es"), "spa"), (2, text("vi"), "en"), (11, G.bare(text("vi").lower()), "vi"), (12, text("pt"), "it")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, issue string, letters int")
    got = {(r.doc_id, r.issue, r["lang"]) for r in G.cases(df, trained).collect()}
    assert got == {(2, "wrong", "vi"), (3, "missing", "fr"), (4, "mixed", "vi"), (4, "mixed", "en"), (12, "wrong", "pt")}
    s = G.segments(df.where("doc_id = 4"), trained).orderBy("segment").collect()
    assert [r["lang"] for r in s] == ["vi", "en"] and all(r.confidence > 0.7 for r in s) and s[0].length == s[1].start
    assert G.cases(df.limit(0), trained).count() == 0


def test_a_second_language_in_unsure_pieces_is_found():
    piece = lambda k, p: np.log(np.where(np.arange(6) == k, p, (1 - p) / 5))
    logp = np.array([piece(0, 0.99)] * 10 + [piece(2, 0.8)] * 8)
    assert G.best_path(logp, np.full(18, 20), 0.9).tolist() == [0] * 10 + [2] * 8
    assert G.best_path(logp, np.r_[np.full(10, 200), np.full(8, 10)], 0.9).tolist() == [0] * 18
    assert set(G.best_path(logp[10:], np.full(8, 20), 0.9).tolist()) == {2}


def test_segments_are_places_of_the_stored_text(spark, trained):
    import copy
    import unicodedata

    random.seed(12)
    text = lambda lang, n=6: " ".join(sentence(lang) for _ in range(n))
    one, two = unicodedata.normalize("NFD", text("vi")).replace(" ", chr(0xA0), 3) + "… " + chr(0x200B), text("de").replace("a", chr(0xFF41), 2)
    df = spark.createDataFrame([(1, f"{one}\n{two}"), (2, text("fr")), (None, text("es"))], "doc_id long, text string")
    s = G.segments(df, trained).where("doc_id = 1").orderBy("segment").collect()
    cut = [f"{one}\n{two}"[r.start : r.start + r.length] for r in s]
    assert "".join(cut) == f"{one}\n{two}" and cut[1].lstrip(f"\n{chr(0x200B)}") == two and [r["lang"] for r in s] == ["vi", "de"]
    strict = copy.copy(trained)
    strict.reject = 1.1
    assert {(r["lang"], r.guess) for r in G.segments(df.where("doc_id = 2"), strict).collect()} == {("unknown", "fr")}
    assert G.cases(df.withColumn("lang", F.lit(None).cast("string")), strict).count() == 0


def test_pieces_end_at_stops_and_lines():
    t = 'One. "Two" 3.5 x... y\r\n\nZ! \'q\' end; a:b: c'
    assert [t[a:b] for a, b in G.pieces_of(t)] == ["One. ", '"Two" 3.5 x... ', "y\r\n\n", "Z! ", "'q' end; ", "a:b: ", "c"]
