import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellum.llm import tokens as K

PATH = f"{K.FOLDER}/{K.VOCABULARY}"
PIECES = ["a", "b c", " ", "\n", "  \n", "đ", "'s", "12", "!", "?!", "x" * 20, "'", "é", "😊", "<|endoftext|>"]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{K.FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=150).map("".join), min_size=10, max_size=30), st.sampled_from([(30, 10, 3), (50, 20, 8), (16, 15, 1), (16, 16, 2)]))
def test_stitched_chunks_equal_whole_texts(spark, reference, texts, size):
    texts = [None, "", *texts]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    chunk, overlap, margin = size
    got = {r.doc_id: r.ids for r in K.encode(df, chunk=chunk, overlap=overlap, margin=margin).collect()}
    assert got == {i: reference(t) for i, t in enumerate(texts)}
    assert all(K.decode(got[i]) == (t or "") for i, t in enumerate(texts))


def test_repeated_ids_and_empty_tables(spark, reference):
    df = spark.createDataFrame([(1, "same text"), (1, "same text"), (None, "no id")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.ids) for r in K.encode(df).collect()), key=repr) == sorted([(1, reference("same text"))] * 2 + [(None, reference("no id"))], key=repr)
    assert K.encode(df.limit(0)).count() == 0


def test_chunks_are_stitched_or_handed_on(spark, reference):
    text = "Học phí kỳ này là 450.000 đồng, don't ask.\n\n  Next  line 12 " * 40
    assert len({K.stitch(text[i : i + 60], 30, 4) for i in range(200)} - {-1}) > 5
    assert K.stitch("x" * 60, 30, 4) == -1 and K.stitch(" " * 60, 30, 4) == -1
    rows = [(1, text), (2, "x" * 5000 + " y " + "z" * 9000), (3, " " * 6000), (4, "漢" * 4500 + text), (5, None), (6, ("a" * 300 + " ") * 60), (7, "\n" * 4090 + "word " * 900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.ids for r in K.encode(df).collect()} == {i: reference(t) for i, t in rows}
