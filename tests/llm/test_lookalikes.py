import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.llm import lookalikes as L

PLAIN = "Điều kiện học phần HP-07 là gì?"
SAME = [
    unicodedata.normalize("NFD", PLAIN),
    PLAIN.replace(" ", chr(0xA0)),
    PLAIN.replace("H", chr(0x41D)).replace("o", chr(0x3BF)),
    PLAIN.replace("Đ", chr(0xD0)),
    PLAIN.replace("0", chr(0xFF10)),
    PLAIN.replace("ki", f"k{chr(0x200B)}i").replace("là", f"l{chr(0xAD)}à"),
    f" {PLAIN}{chr(0xFEFF)}",
    PLAIN.replace("-", chr(0x2011)),
    PLAIN.replace(" ", "  "),
]
DIFFERENT = [PLAIN.lower(), PLAIN.replace("ệ", "ê"), PLAIN.replace("7", chr(0x2077)), PLAIN.replace("Đ", "D"), PLAIN.replace(" ", "\n"), PLAIN.replace("?", "")]


def test_same_and_different():
    f = L.same_look(PLAIN)
    assert [L.same_look(x) for x in SAME] == [f] * len(SAME)
    assert all(L.same_look(x) != f for x in DIFFERENT)
    assert L.same_look("HỌC ß", True) == L.same_look("học SS", True)
    assert L.same_look("👩‍💻") != L.same_look("👩💻") and L.same_look(None) is None


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=30))
def test_idempotent_and_independent_of_composition(t):
    f = L.same_look(t)
    assert L.same_look(f) == f
    assert L.same_look(unicodedata.normalize("NFD", t)) == L.same_look(unicodedata.normalize("NFC", t))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="aĐ é \n-７\tΑ​ọ", max_size=12), min_size=30, max_size=60))
def test_column_equals_function(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.f for r in df.select("i", L.form(F.col("t")).alias("f")).collect()}
    assert [got[i] for i in range(len(texts))] == [L.same_look(t) for t in texts]


def test_column_equals_function_for_each_latin_letter(spark):
    texts = [f"a{chr(i)}b" for i in (*range(0x20, 0x250), *range(0x1E00, 0x1F00))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.f for r in df.select("i", L.form(F.col("t")).alias("f")).collect()}
    assert [t for i, t in enumerate(texts) if got[i] != L.same_look(t)] == []


def test_pairs(spark):
    rows = [("f", "1", PLAIN), ("f", "2", SAME[0]), ("f", "3", SAME[1]), ("f", "4", PLAIN), ("f", "4", PLAIN), ("g", "5", SAME[0]), ("f", "6", None), ("f", "7", " ​"), ("f", "8", " "), (None, "9", PLAIN), ("f", None, SAME[2]), ("f", "10", DIFFERENT[0])]
    df = spark.createDataFrame(rows, "field string, key string, text string").withColumn("form", F.lit("clash"))
    got = sorted((r.key_a, r.key_b) for r in L.same_pairs(df.drop("form")).collect())
    assert got == [("1", "2"), ("1", "3"), ("2", "3"), ("2", "4"), ("3", "4")]
    assert L.same_pairs(df.drop("form").limit(0)).count() == 0 and L.classes(df.limit(0)).count() == 0
    first = min(PLAIN, SAME[0], SAME[1], key=lambda t: t.encode())
    assert {tuple(r) for r in L.classes(df).collect()} == {("f", k, first, 3, 4) for k in "1234"}


def test_many_copies_and_one_key_with_two_texts(spark):
    rows = [("f", f"c{i}", PLAIN) for i in range(500)] + [("f", "x", SAME[1]), ("f", "y", SAME[1]), ("f", "y", PLAIN), ("g", "1", "a" * 9000), ("g", "2", "a" * 8999 + chr(0x430))]
    df = spark.createDataFrame(rows, "field string, key string, text string")
    got = [(r.field, r.key_a, r.key_b) for r in L.same_pairs(df).collect()]
    want = {("f", *sorted((f"c{i}", k))) for i in range(500) for k in "xy"} | {("f", "x", "y"), ("g", "1", "2")}
    assert len(got) == len(set(got)) and set(got) == want
