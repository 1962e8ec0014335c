import json

from pyspark.sql import functions as F

from vellum.sources import files, posts, sinks
from vellum.streaming import ingest, limits


def test_scan_reads_by_ending_and_names_what_it_cannot_read(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("one\n\ntwo", encoding="utf-8")
    (tmp_path / "sub" / "b.CSV").write_text("x,y\n1,2\n,\n", encoding="utf-8")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "d.exe").write_bytes(b"no")
    (tmp_path / "e.html").write_text("<article><p>Hi</p></article>", encoding="utf-8")
    (tmp_path / "f.md").write_bytes("điều".encode("cp1258", errors="replace"))
    s = files.scan(spark, str(tmp_path))
    assert {r.name for r in s.select("name").collect()} == {"a.txt", "b.CSV", "c.pdf", "e.html", "f.md"}
    e = {(r.doc, r.pos): (r.text, r.category) for r in files.elements(s).collect()}
    assert e["a.txt", 1] == ("two", "Text") and e["b.CSV", 0] == ("x | y\n1 | 2", "Table") and e["c.pdf", 0][1] == "Unsupported" and e["e.html", 0][0] == "Hi"
    files.register(".pdf", lambda b: [(b.decode(), "Title", 3)])
    try:
        assert {r.text for r in files.elements(s).where("doc = 'c.pdf'").collect()} == {"%PDF"}
    finally:
        files.READERS.clear()


def test_marked_sections(spark, tmp_path):
    (tmp_path / "m.txt").write_text("T1\nbody\n#####\nT2\nx\ny\n#####\n", encoding="utf-8")
    assert [(r.title, r.body) for r in files.wrapped(spark, str(tmp_path)).orderBy("section").collect()] == [("T1", "body"), ("T2", "x\ny")]


def test_json_lines_append_once(spark, tmp_path):
    p = str(tmp_path / "out")
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id int, v string")
    assert files.append_new(df, p, "id") == 2
    assert files.append_new(df, p, "id") == 0
    lines = tmp_path / "in.jsonl"
    lines.write_text('{"id":1,"c":"x","n":1}\nbroken\n{"id":1,"c":"x","n":2}\n')
    assert [r.n for r in files.latest_json(spark, str(lines), "id int, c string, n int", ["id", "c"], "n").collect()] == [2]


def test_posts_source(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps([{"id": 7, "slug": "s", "title": {"rendered": "A &amp; B"}, "date": "2024-01-01", "link": "u", "content": {"rendered": "<p>x</p>"}}, {"slug": "no id"}]))
    (tmp_path / "2.json").write_text(json.dumps([{"id": 8, "title": "T", "date": "2024-02-01", "modified": "m"}]))
    d = posts.read(spark, str(tmp_path)).collect()
    assert {(r.post_id, r.title, r.modified) for r in d} == {(7, "A & B", "2024-01-01"), (8, "T", "m")}
    assert [r.post_id for r in posts.read(spark, str(tmp_path), 1).collect()] == [8]


def test_run_log(spark):
    r = spark.createDataFrame([("new", None), ("failed", "e2"), ("failed", "e1")], "action string, error string")
    x = sinks.run_log(r, "r1", "manual").first()
    assert (x.new, x.failed, x.skipped, x.errors) == (1, 2, 0, '["e1","e2"]')


def test_merge_replaces_documents_and_repeats_nothing(spark, tmp_path):
    p = str(tmp_path / "store")
    stored = lambda: sorted((r.doc_id, r.content) for r in ingest.chunks(spark, p).select("doc_id", "content").collect())
    did = lambda df, **k: {r.doc_id: r.action for r in ingest.merge(df, p, buckets=2, **k).collect()}
    a = spark.createDataFrame([(1, "One text here."), (2, "Two text here."), (3, None)], "doc_id long, text string")
    assert did(a) == {1: "new", 2: "new", 3: "new"}
    first = stored()
    assert did(a) == {1: "skip", 2: "skip", 3: "skip"} and stored() == first
    b = spark.createDataFrame([(1, "Changed text.")], "doc_id long, text string")
    assert did(b) == {1: "update"}
    assert stored() == sorted([x for x in first if x[0] != 1] + [(1, "Changed text.")])


def test_merge_forgets_emptied_and_removed_documents(spark, tmp_path):
    p = str(tmp_path / "store")
    stored = lambda: sorted((r.doc_id, r.content) for r in ingest.chunks(spark, p).select("doc_id", "content").collect())
    did = lambda rows, **k: {r.doc_id: r.action for r in ingest.merge(spark.createDataFrame(rows, "doc_id long, text string"), p, buckets=16, **k).collect()}
    did([(1, "One text here."), (2, "Two text here."), (3, "Three.")])
    assert did([(1, "")]) == {1: "update"} and stored() == [(2, "Two text here."), (3, "Three.")]
    assert did([(1, "")]) == {1: "skip"} and did([(1, None)]) == {1: "skip"}
    assert did([(2, "Two text here.")], complete=True) == {1: "delete", 2: "skip", 3: "delete"} and stored() == [(2, "Two text here.")]
    assert did([(3, "Three.")]) == {3: "new"} and len(stored()) == 2


def test_stream_ingest(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    spark.createDataFrame([(1, "Hello there."), (2, "Second one.")], "doc_id long, text string").write.mode("append").json(str(src))
    s = spark.readStream.schema("doc_id long, text string").json(str(src))
    for _ in range(2):
        q = ingest.run(s, str(tmp_path / "store"), str(tmp_path / "state"), availableNow=True)
        q.awaitTermination(120)
    assert ingest.chunks(spark, str(tmp_path / "store")).count() == 2


def _play(spark, tmp_path, df, f, name, mode="append"):
    src = str(tmp_path / name)
    df.write.json(src)
    out = f(spark.readStream.schema(df.schema).json(src))
    q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    q.awaitTermination(20)  # one with timeouts by the clock goes on
    q.stop()
    return spark.table(name)


def test_stream_rate_limit(spark, tmp_path):
    df = spark.createDataFrame([("a", s) for s in (20, 0, 10, 61)] + [("b", 5)], "key string, s long").select("key", F.timestamp_seconds("s").alias("ts"))
    got = _play(spark, tmp_path, df, lambda s: limits.rate_limit(s, 2), "limited")
    assert {(r.key, r.ts.second + 60 * r.ts.minute, r.accepted) for r in got.collect()} == {("a", 0, True), ("a", 10, True), ("a", 20, False), ("a", 61, True), ("b", 5, True)}


def test_stream_windows_and_frames(spark, tmp_path):
    df = spark.createDataFrame([(0, "db", 10.0), (60, "db", 30.0), (3600, "db", 5.0)], "s long, stage string, ms double").select(F.timestamp_seconds("s").alias("ts"), "stage", "ms")
    got = _play(spark, tmp_path, df, lambda s: limits.stage_windows(s), "staged", "complete")
    assert {(r.n, r.mean, r.max) for r in got.collect()} == {(2, 20.0, 30.0), (1, 5.0, 5.0)}
    f = limits.frames(spark.createDataFrame([("data: [STATUS]busy\n\ndata: hello\n\ndata: [DONE]\n\n",)], "value string"))
    assert [(r.kind, r.text) for r in f.collect()] == [("status", "busy"), ("delta", "hello"), ("done", "")]


def test_watcher_sees_edits_of_equal_size(spark):
    w, a = limits.Watcher(), spark.createDataFrame([(1, "a")], "id int, t string")
    assert [w.changed(a), w.changed(a), w.changed(a.withColumn("t", F.lit("b")))] == [False, False, True]


def _zip(path, parts):
    import zipfile

    with zipfile.ZipFile(path, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)


def test_word_and_excel_files(spark, tmp_path):
    from vellum.operators import structure
    from vellum.sources import office

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f'<w:p><w:pPr>{s}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t, s="": f"<w:tc><w:tcPr>{s}</w:tcPr>{p(t)}</w:tc>"
    table = f"<w:tbl><w:tr>{cell('Course')}{cell('Fee')}</w:tr><w:tr>{cell('A|B')}{cell('5', '<w:vMerge w:val=\"restart\"/>')}</w:tr><w:tr>{cell('C')}{cell('x', '<w:vMerge/>')}</w:tr></w:tbl>"
    page = '<w:p><w:r><w:br w:type="page"/></w:r></w:p>'
    _zip(tmp_path / "a.docx", {"word/document.xml": f"<w:document {w}><w:body>{p('Lead in.')}{p('Fees', '<w:pStyle w:val=\"Heading1\"/>')}{p('They are due.')}{page}{table}{p('1.1 More')}{p('End.')}</w:body></w:document>"})
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    rows = '<row r="1"><c r="A1" t="inlineStr"><is><t>Fees of 2024</t></is></c></row><row r="3"><c r="A3" t="s" s="1"><v>0</v></c><c r="B3" t="s" s="1"><v>1</v></c></row>' + "".join(f'<row r="{i}"><c r="A{i}" t="inlineStr"><is><t>c,{i}</t></is></c><c r="B{i}"><v>{i}.0</v></c></row>' for i in range(4, 12))
    _zip(tmp_path / "b.xlsx", {"xl/workbook.xml": f'<workbook {s}><sheets><sheet name="S1" sheetId="1" r:id="rId1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>', "xl/sharedStrings.xml": f"<sst {s}><si><t>Course</t></si><si><r><t>Fee</t></r></si></sst>", "xl/styles.xml": f'<styleSheet {s}><fonts><font/><font><b/></font></fonts><cellXfs><xf fontId="0"/><xf fontId="1"/></cellXfs></styleSheet>', "xl/worksheets/sheet1.xml": f"<worksheet {s}><sheetData>{rows}</sheetData></worksheet>"})
    (tmp_path / "c.docx").write_bytes(b"no zip")
    found = files.scan(spark, str(tmp_path))
    e = {}
    for r in files.elements(found).orderBy("doc", "pos").collect():
        e.setdefault(r.doc, []).append((r.text, r.category, r.page))
    assert e["a.docx"] == [("Lead in.", "Text", 1), ("Fees", "Title", 1), ("They are due.", "Text", 1), ("| Course | Fee |\n|---|---|\n| A/B | 5 |\n| C |  |", "Table", 2), ("1.1 More", "Text", 2), ("End.", "Text", 2)]
    assert e["b.xlsx"][0][0].startswith("### S1\n\n| Fees of 2024 |  |") and e["c.docx"][0][1] == "Broken"
    n = [(r.level, r.path, r.pages, r.has_table) for r in structure.element_outline(files.elements(found)).where("doc = 'a.docx'").orderBy("pos").collect()]
    assert n == [(0, [], [1], False), (2, ["Fees"], [1, 2], True), (2, ["1.1 More"], [2], False)]
    c = [(r.content, r.pages, r.has_table) for r in structure.element_chunks(files.elements(found)).where("doc = 'a.docx'").orderBy("chunk").collect()]
    assert c[0] == ("Lead in.", [1], False) and c[1][1:] == ([1, 2], True) and "| A/B | 5 |" in c[1][0] and c[2][1:] == ([2], False)
    got = [r.content for r in office.sheet_chunks(found, 14).orderBy("chunk").collect()]
    assert got[0] == "b - S1:\nFees of 2024," and got[1].startswith("(") and all("Course,Fee" in x for x in got[1:]) and sum(int(x[1 : x.index(" of")]) for x in got[1:]) == 8
    assert office.csv_files((tmp_path / "b.xlsx").read_bytes())[0][1].startswith(b"\xef\xbb\xbfFees of 2024")
    assert office.is_noise([["Bộ Giáo dục", "Cộng hoà xã hội"], ["x", "y"], ["1", "2"], ["3", "4"]]) and office.is_noise([["a"], ["b"]]) and not office.is_noise([["a", "b"], ["c", "d"]])


def test_one_job_of_a_name_and_models_in_turn(spark, tmp_path):
    import time

    from vellum.streaming import jobs

    seen = []
    q, new = jobs.every(spark, 1, seen.append, str(tmp_path / "ticks"), "ticks")
    again, second = jobs.every(spark, 1, seen.append, str(tmp_path / "other"), "ticks")
    try:
        assert new and not second and again.id == q.id
        end = time.time() + 60
        while len(seen) < 2 and time.time() < end:
            time.sleep(0.2)
        assert seen[:2] == [0, 1]
    finally:
        q.stop()
    waits, calls = [], []

    def busy(x):
        calls.append(x)
        raise RuntimeError("503 overloaded")

    def broken(x):
        raise ValueError("no such model")

    assert jobs.failover([busy, broken, lambda x: x + 1], 3, 10, 15, waits.append)(1) == 2
    assert waits == [10, 15] and calls == [1, 1, 1]


def test_token_counts(spark):
    import pytest

    from vellum.operators import models

    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    texts = ["Học phí là 5.000 đồng", "", None, "don't  stop\n\n1"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string")
    assert [r.n for r in df.select("i", models.counted(F.col("t")).alias("n")).orderBy("i").collect()] == [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]
