from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.functions import markdown as M
from vellum.functions import speech
from vellum.functions import text as T


def one(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r.x for r in df.select("i", f(F.col("c")).alias("x")).orderBy("i").collect()]


def test_keys_fold_composed_and_combining_accents(spark):
    assert one(spark, T.plain_key, "Đào  tạo!", "Đào tạo", None, "", "K63-A") == ["dao tao", "dao tao", "", "", "k63 a"]


def test_expansion_works_on_the_growing_text_and_skips_what_is_there(spark):
    got = one(spark, T.expand, "ĐRL và ktx", "điểm đầu vào (điểm chuẩn tuyển sinh)", None, "hpx")
    assert got == ["ĐRL (điểm rèn luyện) và ktx (ký túc xá)", "điểm đầu vào (điểm chuẩn tuyển sinh)", "", "hpx"]
    assert one(spark, T.unabbreviate, "ktx ở đâu") == ["ký túc xá ở đâu"]


def test_content_words_keep_order_numbers_and_questions(spark):
    assert one(spark, T.content_words, "Cho em hỏi học phí 1,5 triệu là như thế nào ạ", None) == [["học", "phí", "1.5", "triệu", "thế_nào"], []]
    assert one(spark, T.canonical, "ktx ở đâu ạ") == ["ktx ở đâu"]


def test_number_sets(spark):
    df = spark.createDataFrame([("1,5 và 2", "2 hay 1.5 2"), ("1", "2"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(T.same_numbers(F.col("a"), F.col("b"))).collect()] == [True, False, True]


def test_names(spark):
    assert one(spark, T.base_name, "a\\b/c.PDF", "x") == ["c.PDF", "x"]
    assert one(spark, T.file_ending, "a/b.TAR.GZ", "none") == [".gz", ""]
    assert one(spark, T.is_source_name, "a.pdf", " ", "x.PNG", None) == [True, False, False, False]
    assert one(spark, T.slug, "Thông báo: K63!", None) == ["thông-báo-k63", "item"]
    assert one(spark, T.pretty_title, "So_tay_2024.pdf") == ["So tay 2024"]


def test_tails_and_sizes(spark):
    assert one(spark, lambda c: T.overlap_tail(c, 6), "short", "one two three", "abcdefghij") == ["", "three", ""]
    assert one(spark, T.estimated_tokens, "", "x" * 9) == [1, 2]
    assert one(spark, T.token_length, "", "a b c d") == [1, 5]


def test_key_value_priority(spark):
    got = one(spark, T.key_value, "a - b: c", "a - b", "none", ":x")
    assert [g and (g.key, g.value) for g in got] == [("a - b", "c"), ("a", "b"), None, None]


def test_articles_and_citations(spark):
    assert one(spark, T.articles, "Điều 12, điều 5 và điều 12", None) == [[5, 12], []]
    assert one(spark, T.cites, "khoản 2", "khoảng 2", None) == [True, False, False]


def test_audio(spark):
    df = spark.createDataFrame([(bytearray(b"RIFF1234WAVEfmt "),), (bytearray(b"ID3" + b"x" * 20),), (bytearray(b"short"),), (bytearray(b"zzzzzzzzzzzzzz"),)], "c binary")
    assert [r[0] for r in df.select(T.audio_format(F.col("c"))).collect()] == ["wav", "mp3", None, None]


def test_speech(spark):
    got = one(spark, speech.spoken, "Hạn **15/09/2026** lúc 7h30, giảm 6,10% [1]", "- ktx 7-8 triệu/tháng\n- điểm ĐRL", None, "| a | b |\n|---|---|\n| x | 1 |", "024-3852")
    assert got == ["Hạn ngày 15 tháng 9 năm 2026 lúc 7 giờ 30, giảm 6 phẩy 10 phần trăm.", "ký túc xá 7 đến 8 triệu một tháng. điểm rèn luyện.", "", "x, b: 1.", "024-3852."]
    assert one(spark, lambda c: speech.cut_at_sentence(c, 12, "+"), "One. Two. Three four.", "short", "abcdefgh ijklmnop") == ["One. Two.+", "short", "abcdefgh+"]


def test_tables_there_and_back():
    t = "| a | b | c |\n|---|---|---|\n| x | y | 1 |\n| p | q | 2 |"
    wide = M.repair(t.replace("| y |", f"| {'y' * 200} |"))
    assert wide.startswith("- **x**\n  - yyy")
    assert M.repair(t) == t
    back = M.lists_to_tables(wide)
    assert back.split("\n")[2].startswith("| x | yyy") and back.count("\n") == 3


def test_short_answers_become_tables():
    assert M.finish("Phí: 10\nLớp: 20\nPhòng: 3", True).startswith("| Item | Content |")
    assert M.finish("Phí: 10\nLớp: 20\nPhòng: 3") == "Phí: 10\nLớp: 20\nPhòng: 3"
    assert M.finish("Ngành A\nMã: 1\nPhí: 2\nNgành B\nMã: 3\nPhí: 4").split("\n")[0] == "| Name | Mã | Phí |"
    assert M.finish(None) == "" and M.finish("a<br>b\n\n\n\nc") == "a\nb\n\nc"


def test_shown_matches_the_plain_function(spark):
    texts = ["| a | b |\n|---|---|\n| x | y\nz |\nend", "plain", "  edge \n", "a\n\n\n\nb", None]
    assert one(spark, M.shown, *texts) == [None if t is None else M.finish(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="|-: a\n*b<br>", max_size=80))
def test_display_is_stable(text):
    once = M.finish(text)
    assert M.finish(once) == once or "|" in once or "<" in once
    assert M.joined(M.blocks(text)) == text
