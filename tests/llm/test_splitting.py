import re

from hypothesis import given, settings
from hypothesis import strategies as st

from vellum.llm import splitting as S


def greedy(text, limit, overlap):
    """The same rules, piece after piece."""
    ends, starts, ranks = (x.tolist() for x in S.boundaries(text))
    words = [0, *starts[:-1]]
    out, s, e = [], 0, 0
    while True:
        pick = None
        for r in (3, 2, 1, 0):
            c = [x for x, k in zip(ends, ranks) if k >= r and e < x <= s + limit and (r == 0 or x > s + limit // 2)]
            if c:
                pick = max(c)
                break
        if pick is None and s + limit < len(text):
            k = min(i for i, x in enumerate(ends) if x > e)
            if ends[k] - words[k] <= limit:
                s, pick = min(x for x in words if x >= ends[k] - limit), ends[k]
        if s + limit >= len(text):
            return [*out, (s, len(text), False)]
        e = s + limit if pick is None else pick
        out.append((s, e, pick is None))
        c = [w for w in words if e - overlap <= w < e]
        s = e if pick is None else min(c) if c else min(b for a, b in zip(ends, starts) if a >= e)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", ". ", " ", "\n", "\n\n", "\f", "x", "x" * 5, "x" * 41, "x" * 130, "word ", "! "]), min_size=20, max_size=200), st.sampled_from([(40, 10), (60, 29), (100, 0)]))
def test_pointer_doubling_equals_the_greedy_walk(parts, size):
    text = "".join(parts).strip(S.BLANK)
    limit, overlap = size
    got = S.cuts(text, limit, overlap)
    if len(text) <= limit:
        assert got == ([(0, len(text), False)] if text else [])
        return
    assert got == greedy(text, limit, overlap)
    assert all(b - a <= limit for a, b, _ in got)
    assert any(f for *_, f in got) == bool(re.search(rf"[^ \t\n\r\f]{{{limit + 1},}}", text))
    covered = set().union(*(range(a, b) for a, b, _ in got))
    assert all(i in covered or text[i] in S.BLANK for i in range(len(text)))


def test_table_with_nulls_ties_and_odd_pages(spark):
    long = "word " * 300
    rows = [("a", long, [3, 3], "x"), ("a", long, [3, 3], "x"), ("b", None, None, "x"), ("c", "  \n" * 900, [1], "x"), ("d", f"{'y' * 1300}\f{long}", [9, 2], "x"), ("e", f" \f{long}", None, "x"), ("f", "z" * 1200, [1], "x"), (None, long, [], "x")]
    df = spark.createDataFrame(rows, "id string, content string, pages array<int>, piece string")
    assert {(r.chunk_id, r.cut) for r in S.cut_kinds(df).collect()} == {("a", "natural"), ("d", "forced"), ("e", "natural"), (None, "natural")}
    p = {(r.chunk_id, r.piece): r for r in S.split_long(df).collect()}
    assert p["a", 0].pages == [3] and p["d", 0].pages == [9] and p["d", 1].pages == [9, 2] and p["e", 0].pages == []
    assert p["a", 1].content.startswith("word") and 95 <= p["a", 0].start + p["a", 0].length - p["a", 1].start <= 100
    assert S.cut_kinds(df.limit(0)).count() == 0
