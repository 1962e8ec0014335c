import random

from pyspark.sql import functions as F

from vellum.operators import changes as X
from vellum.operators import html as H
from vellum.operators import structure as S


def col(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r.x for r in df.select("i", f(F.col("c")).alias("x")).orderBy("i").collect()]


def test_heading_levels(spark):
    got = col(spark, S.heading_level, "Chương 1 Mở đầu", "Mục 2", "Điều 5. Phạm vi", "khoản 3", "a) ý", "c) Nộp hồ sơ", "i) nhỏ", "IV. Kết", "iv) x", "1. Một", "1.2 Hai", "1.2.3. Ba", "1.2.3.4 Bốn", "thường", "", None)
    assert got == [1, 2, 2, 3, 4, 4, 4, 1, 1, 1, 2, 3, 4, None, None, None]
    assert col(spark, S.roman, "iv", "xc", "xiv", "") == [4, 90, 14, 0]
    assert col(spark, S.looks_like_heading, "THÔNG BÁO", "Thông báo", "123", None) == [True, False, False, False]


def test_outline_keeps_paths_and_text_before_headings(spark):
    t = "lead\n1. A\nx\n1.1 B\ny\nz\n2. C"
    rows = S.outline(spark.createDataFrame([(1, t), (2, None), (3, "")], "doc_id int, text string")).orderBy("pos").collect()
    assert [(r.level, r.path, r.content) for r in rows] == [(0, [], "lead"), (1, ["1. A"], "x"), (2, ["1. A", "1.1 B"], "y\nz"), (1, ["2. C"], "")]


def test_sections_are_islands(spark):
    t = "A TITLE LINE\n1. one\nx\n2. two\nOTHER PART\ny\n-----\nz"
    rows = S.sections(spark.createDataFrame([(1, t)], "doc_id int, text string")).orderBy("from_pos").collect()
    assert [(r.section, r.record, r.content) for r in rows] == [("A TITLE LINE", None, ""), ("A TITLE LINE", "1. one", "x"), ("A TITLE LINE", "2. two", ""), ("OTHER PART", None, "y\nz")]


def test_windows_overlap(spark):
    t = " ".join(f"w{i}" for i in range(500))
    rows = S.word_windows(spark.createDataFrame([(1, t), (2, "short"), (3, None), (4, "  ")], "doc_id int, text string")).orderBy("start").collect()
    assert [(r.start, len(r.content.split())) for r in rows] == [(0, 250), (200, 250), (400, 100)]


def test_sentences_keep_numbers_and_initials(spark):
    assert col(spark, S.split_sentences, "Xem mục 1. Điều này. Ông A. Nam đến! Xong?", "", None) == [["Xem mục 1. Điều này.", "Ông A. Nam đến!", "Xong?"], [], []]


def test_packing_keeps_sentences_whole_and_overlaps():
    text = " ".join(f"Sentence number {i} here." for i in range(100))
    got = S.pack([(["T"], text)], most=60, overlap=30)
    assert len(got) > 5 and all(c.startswith("T.\n") for c in got)
    for i in range(100):
        assert any(f"Sentence number {i} here." in c for c in got)
    assert all(S._cost(c) <= 90 for c in got)
    assert S.pack([]) == [] and S.pack([(["Only"], "")]) == ["Only."]


def test_markdown_tables(spark):
    df = spark.createDataFrame([([["a", "b"], ["1", "x|y"], ["", ""], ["2"]],), ([["a"], ["b"]],), ([["a", "b"]],)], "r array<array<string>>")
    assert [r[0] for r in df.select(S.to_markdown(F.col("r"))).collect()] == ["| a | b |\n|---|---|\n| 1 | x/y |\n| 2 |  |", None, None]


def test_actions_are_idempotent(spark):
    a = spark.createDataFrame([(1, "h1"), (2, "h2"), (3, "h3")], "doc_id int, file_hash string")
    b = spark.createDataFrame([(2, "h2"), (3, "old"), (4, "h4")], "doc_id int, file_hash string")
    assert {(r.doc_id, r.action) for r in X.actions(a, b).collect()} == {(1, "new"), (2, "skip"), (3, "update"), (4, "delete")}
    assert {r.action for r in X.actions(a, a).collect()} == {"skip"}
    assert X.actions(a.limit(0), b.limit(0)).count() == 0


def test_upsert_and_delete(spark):
    a = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    b = spark.createDataFrame([(1, "new", 2), (3, "c", 1), (3, "d", 0)], "k int, v string, t int")
    u = X.upsert(a, b, ["k"], "t")
    assert {(r.k, r.v) for r in u.collect()} == {(1, "new"), (2, "b"), (3, "c")}
    assert {r.k for r in X.delete(u, b, ["k"]).collect()} == {2}


def test_article_states(spark):
    inc = spark.createDataFrame([(1, "m1", "x" * 60, []), (2, "m2", "x" * 60, []), (3, "m3", "x", []), (4, "m4", "x", [("f", "u")])], "post_id int, modified string, content string, attachments array<struct<name:string,url:string>>")
    known = spark.createDataFrame([(1, "m1", "ok"), (2, "old", "ok")], "post_id int, modified string, status string")
    assert {(r.post_id, r.action) for r in X.article_actions(inc, known).collect()} == {(1, "skipped"), (2, "updated"), (3, "skipped"), (4, "new")}


def test_resolution_prefers_exact_names(spark):
    c = spark.createDataFrame([("a", "X_1.pdf", "My File.pdf", None), ("b", "Y.pdf", "X_1.pdf", None)], "id string, filename string, original_name string, created_at timestamp_ntz")
    n = spark.createDataFrame([("x-1.pdf",), ("my_file.docx",), ("no.pdf",), (None,)], "name string")
    assert {(r.name, r.id, r.tier) for r in X.resolve(n, c).collect()} == {("x-1.pdf", "a", 1), ("my_file.docx", "a", 3)}


def test_pages(spark):
    page = "<h1 class='entry-title'>T &amp; U</h1><time datetime='2024-01-02'>x</time><div class='entry-content'><script>no</script><p>Hello <b>you</b></p><ul><li>one<li>two</ul><table><tr><td>a<td>b|c</tr></table><a href='/f/x.pdf?x=1'>file</a><a href='mailto:a@b'></a><h2>Head</h2></div>"
    df = spark.createDataFrame([(1, "https://ex.org/a", page), (2, None, None)], "page_id int, url string, html string")
    r = {x.page_id: x for x in H.articles(df).collect()}
    assert (r[1].title, r[1].date, r[1].attachments[0].name) == ("T & U", "2024-01-02", "file")
    assert "no" not in r[1].content.split() and "| a | b\\|c |" in r[1].content and "### Head" in r[1].content and "a@b" in r[1].content
    assert (r[2].title, r[2].content) == ("Notice", "")
    assert H.links("<a href='/tin/bai-123/#x'>a</a><a href='/tin/bai-123/'>b</a><a href='https://o.org/b-1'>b</a><a href='/category/x-1/'>c</a>", "https://ex.org/") == ["https://ex.org/tin/bai-123/"]


def test_unclosed_markup_never_fails():
    random.seed(1)
    for _ in range(200):
        t = "".join(random.choice(["<p>", "</p>", "<table>", "<td>", "</tr>", "<a href=", "'x'>", "&amp", "text", "<!--", "-->", "<"]) for _ in range(20))
        H.article(t, "http://a.b/c")
