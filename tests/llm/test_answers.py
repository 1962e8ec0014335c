import os

import pytest

from vellum.llm import answers as A
from vellum.llm import languages

Q = "Học phí học phần MA101 là bao nhiêu?"


@pytest.fixture(scope="module")
def model(spark):
    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no tables here")
    return languages.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


@pytest.mark.parametrize(
    ("query", "answer", "want"),
    [
        (Q, None, "empty"), (Q, " ​\n", "empty"), (Q, "N/A", "empty"), (Q, "(trống)", "empty"), (Q, "** **", "empty"), (Q, "...", "empty"),
        (Q, "Xin lỗi, tôi không thể trả lời câu hỏi này.", "refusal"), (Q, "Chào bạn! I'm sorry, but I can't help with that request.", "refusal"), (Q, "xin loi, toi khong the tra loi cau hoi nay", "refusal"),
        (Q, "Je n'ai trouvé aucune information à ce sujet.", "refusal"), (Q, "Das kann ich leider nicht beantworten.", "refusal"), (Q, "Lo siento, no puedo responder a esa pregunta.", "refusal"), (Q, "Infelizmente não posso responder.", "refusal"), (Q, "I do not know.", "refusal"),
        (Q, "Xin lỗi vì phản hồi chậm. Học phí là 500.000 đồng.", None), (Q, "Sinh viên không thể nộp muộn hơn ngày 12/3/2024.", None), ("May I sit the test?", "Anyone who misses more than 9 classes may not sit the final test.", None),
        (Q, Q, "copy"), (Q, f"“{Q}”", "copy"), (Q, f"Câu hỏi: {Q}", "copy"), (Q, f"{Q} {Q}", "copy"), (Q, f"{Q}\nHọc phí là 500.000 đồng.", None),
        (Q, "The fee for the course is 500 and must be paid before the end of May.", "other_language"), ("Answer in English: " + Q, "The fee for the course is 500 and must be paid before May.", None), ("Hoc phi hoc phan la bao nhieu?", "Học phí của học phần là 500.000 đồng.", None),
        ("Chuẩn tiếng Anh của ngành Luật ra sao?", "The language requirement of the course applies from May onwards.", "other_language"), (None, "Text.", None),
        ("When does the office open?", "Le secrétariat ouvre lundi matin.", "other_language"), ("Cost of the HP-Ơ-00118 laboratory kit, per month?", "The fee for the course must be paid before May.", None), (Q, "La carrera de logística admite a 13 personas.", "other_language"),
        ("Can I hand it in later?", "We cannot extend the deadline.", None), ("Where can I read it?", "Students may not enter; no information is available online.", None), ("Soll ich warten?", "Ich empfehle das nicht, keine Anmeldung nach Mai.", None),
        ("What is the fee?", "I'm afraid that lies past my remit.", "refusal"), ("What is the fee?", "That is something I'd rather leave to the registry.", "refusal"),
    ],
)
def test_what_a_row_shows(model, query, answer, want):
    assert A.plain_defects([(query, answer), (Q, None)], model) == [want, "empty"]


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        ("Dữ liệu hiện có không đề cập tới LG3286, vì vậy mình xin phép không trả lời.", True), ("Unfortunately I have no information about CE2905 in the documents.", True), ("Tôi không biết học phí của CE2905 năm 2024.", True),
        ("I do not know. Please contact room B8-418 or call 0292-3832663.", True), ("Je ne peux pas répondre sur le cours CE2905.", True), ("Ich habe keine Informationen zu CE2905.", True), ("No tengo información sobre CE2905.", True), ("Não encontrei nada sobre CE2905 de 12/03/2024.", True),
        ("We will not accept files after 12/03/2024.", False), ("It is not allowed to enter room B8-418 after 18:00.", False), ("No se admiten solicitudes después del 12/03/2024.", False), ("Sinh viên không thể cung cấp bản sao sau ngày 12/3/2024.", False), ("Hồ sơ không có tài liệu về học phí trước 12/3/2024 phải nộp lại.", False),
        ("I am not sure, but the fee is 500.000 dong.", False), ("Mình không chắc, học phí là 500.000 đồng.", False), ("I do not know. The fee of CE2905 is 500.", False), ("I do not know. Sorry, the fee is 500.", False),
    ],
)
def test_numbers_of_what_was_asked_do_not_hide_a_refusal(answer, want):
    assert A.refuses(answer) is want


@pytest.mark.parametrize(("text", "state"), [("Done.", "closed"), ("Done 😊", "closed"), ("Done. 😊", "closed"), ("1. One.\n2. Two.\n3.", "cut"), ("See:\n", "cut"), ("A ```code\nx = [", "cut"), ("A (b", "cut"), ("Mail: a.b@c.example", "closed"), ("no stop here", "open")])
def test_endings(text, state):
    assert A.ending(text)[0] == state


def test_truncation_needs_the_other_answers(spark, model):
    full = [f"Students of cohort K{i} must bring a copy of the transcript to the registry." for i in range(30)] + [f"The library lends up to {i} books at a time and renews each loan twice." for i in range(30)]
    rows = [(i, "Which room is it?", t) for i, t in enumerate(full)]
    rows += [(100, "q", "The library lends up to 5 books at a time and renews each loan twice"), (101, "q", "The library lends up to 7 books at a"), (102, "q", "Students of cohort K7 must bring a copy of the trans"), (103, "q", full[0] + " The library lends"), (104, "q", "Please bring the following:"), (101, "q", "The library lends up to 7 books at a"), (None, "q", "x y")]
    df = spark.createDataFrame(rows, "entry_id long, query string, answer string")
    df = df.withColumn("size", df.entry_id).withColumn("last", df.answer)
    assert {(r.entry_id, r.defect) for r in A.defects(df, model).collect()} == {(101, "truncated"), (102, "truncated"), (103, "truncated"), (104, "truncated")}
    assert A.defects(df.limit(0), model).count() == 0


def test_neighbours_see_past_the_end_of_a_range(spark):
    texts = [("ab", True), ("abc", False), ("b", True), ("c", False), ("d", True), ("da", False), ("e", True)]
    df = spark.createDataFrame(texts, "sentence string, asks boolean").repartition(5)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {(r["last"], r.longer) for r in A.shortened(df).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == {("ab", True), ("b", False), ("d", True), ("e", False)}


def test_spikes(spark):
    df = spark.createDataFrame([(s, 10) for s in range(90, 110) if s != 100] + [(100, 200), (500, 19)], "size int, n long")
    assert {r.size for r in A.spikes(df).collect()} == {100, 500}
    few = spark.createDataFrame([(s, 1) for s in range(90, 110)] + [(200, 5)], "size int, n long")
    assert A.spikes(few).count() == 0
