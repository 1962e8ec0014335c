import random

from vellum.llm import leaks as L

random.seed(4)
WORDS = [f"w{i}" for i in range(400)]
PASSAGES = {i: " ".join(random.choice(WORDS) for _ in range(60)) for i in range(5)}


def cover(p, d, n=5):
    g = {tuple(d[i : i + n]) for i in range(len(d) - n + 1)}
    c = [False] * len(p)
    for i in range(len(p) - n + 1):
        if tuple(p[i : i + n]) in g:
            c[i : i + n] = [True] * n
    return sum(c)


def test_words_ignore_case_accents_markup_and_line_ends():
    assert L.words("Điều **1**: <b>Học</b>\r\nphí&nbsp;[x](http://a.b/c) l­ạ") == ["dieu", "1", "hoc", "phi", "x", "la"]
    assert L.words(None) == [] and L.words("") == []


def test_found_documents(spark):
    p = PASSAGES[0].split()
    fill = lambda n: " ".join(random.choice(WORDS) for _ in range(n))
    edited = [w if i % 9 else "edited" for i, w in enumerate(p)]
    docs = [(1, f"{fill(50)} {PASSAGES[0].upper()} {fill(20)}"), (2, f"{fill(9)} {' '.join(p[10:31])} end"), (3, f"{fill(9)} {' '.join(p[10:25])} end"), (4, " ".join(edited)), (5, f"{' '.join(p[40:52])} gap {' '.join(p[0:12])}"), (6, " ".join(p[i] for i in range(0, 60, 2))), (7, None), (8, ""), (9, fill(300)), (1, f"{fill(50)} {PASSAGES[0].upper()} {fill(20)}"), (10, PASSAGES[3].replace(" ", "\n- "))]
    d = spark.createDataFrame([(*x, "y") for x in docs], "doc_id long, text string, passage string")
    items = spark.createDataFrame([*((i, "q", t) for i, t in PASSAGES.items()), (0, "q", PASSAGES[0]), (9, "q", None), (10, "q", "")], "item_id long, question string, passage string")
    got = {(r.doc_id, r.item_id): r.words_matched for r in L.leaks(d, items).collect()}
    assert got == {(1, 0): 60, (2, 0): 21, (4, 0): cover(p, edited), (5, 0): 24, (10, 3): 60}
    assert {(r.doc_id, r.item_id) for r in L.found(d, items).collect()} == set(got) and {(r.doc_id, r.item_id) for r in L.leaks(d, items, common=0).collect()} == set(got)
    assert L.leaks(d.limit(0), items).count() == 0 and L.leaks(d, items.limit(0)).count() == 0


def test_passages_that_share_their_words_keep_their_seeds(spark):
    same = PASSAGES[1]
    items = spark.createDataFrame([(i, same) for i in range(20)], "item_id long, passage string")
    d = spark.createDataFrame([(1, same)], "doc_id long, text string")
    assert {r.item_id for r in L.leaks(d, items).collect()} == set(range(20))


def test_wording_of_many_items_alone_is_a_leak_of_each(spark):
    rng = random.Random(9)
    word = lambda k: " ".join(f"{k}{rng.randrange(10**6)}" for _ in range(36))
    same = [f"s{i}" for i in range(24)]
    passages = {i: f"{' '.join(same)} {word(f'i{i}x')}" for i in range(12)} | {20 + i: f"{' '.join(same[:16])} {word(f'j{i}x')} {word(f'k{i}x')}" for i in range(12)}
    texts = {1: " ".join(same), 2: " ".join(same[:21]), 3: " ".join(same[:18]), 4: f"{' '.join(same[:12])} gap {' '.join(same[12:])}", 5: passages[20], 6: " ".join(same[::2]), 7: "x y"}
    items = spark.createDataFrame(list(passages.items()), "item_id long, passage string")
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = {(d, i, n) for d, t in texts.items() for i, p in passages.items() if (n := cover(p.split(), t.split())) >= len(p.split()) / 3}
    assert {(d, i) for d, i, _ in want} == {(d, i) for d in (1, 2, 4) for i in range(12)} | {(5, 20)}
    assert {(r.doc_id, r.item_id, r.words_matched) for r in L.leaks(docs, items).collect()} == want
    assert {(r.doc_id, r.item_id, r.words_matched) for r in L.leaks(docs, items, common=100).collect()} == want


def test_ten_items_that_share_most_of_their_words(spark):
    rng = random.Random(5)
    word = lambda n: [f"u{rng.randrange(10**6)}" for _ in range(n)]
    same = word(60)
    own = {i: word(20) for i in range(10)}
    items = spark.createDataFrame([(i, " ".join(same + o)) for i, o in own.items()], "item_id long, passage string")
    docs = spark.createDataFrame([(1, " ".join(word(30) + same + word(9))), (2, " ".join(same + own[3])), (3, " ".join(own[4]))], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in L.leaks(docs, items).collect()}
    assert got == {(d, i) for d in (1, 2) for i in range(10)}


def test_edited_copies_are_scored_by_alignment(spark):
    p = PASSAGES[2].split()
    docs = [(1, " ".join("new" if i % 5 == 4 else w for i, w in enumerate(p))), (2, " ".join(w for i, w in enumerate(p) if i % 6 != 5)), (3, " ".join(p[i] for i in range(0, 60, 2)))]
    items = spark.createDataFrame([(2, PASSAGES[2])], "item_id long, passage string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.words_matched, round(r.score, 2)) for r in L.leaks(d, items).collect()}
    assert got == {1: (0, 0.8), 2: (50, 0.83)}
    assert {r.doc_id for r in L.found(d, items).collect()} == {2}


def test_words_are_folded_one_by_one_only_where_that_is_the_same():
    import xxhash

    codes = L.Codes()
    odd = ["Điều 1: Học phí", "e\u0301cole \u00bd kg \u338f", "a\u200bb a\u00adb", "ﬁn ＡＢ ①", "x < y & z", "<b>T\u0323</b> 😊 𝒜b", "Straße İstanbul", "ก่อน", "a_b-c"]
    for t in odd:
        assert codes.of(t) == [xxhash.xxh64_intdigest(w) for w in L.words(t)], t


def test_long_texts_are_aligned_in_parts(spark):
    p = PASSAGES[1]
    long = [f"v{i}" for i in range(5000)]
    items = spark.createDataFrame([(1, p), (2, " ".join(long)), (3, "w1 w2"), (4, None)], "item_id long, passage string")
    docs = [(1, f"{p} x " * 300), (2, " ".join(long[:3000])), (3, " ".join(long[:1000])), (4, "w1 w2 and"), (5, "y " * 60000 + p), (None, p)]
    got = {(r.doc_id, r.item_id): r.words_matched for r in L.leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert {k: v for k, v in got.items() if k[1] != 3} == {(1, 1): 60, (2, 2): 3000, (5, 1): 60} and got[4, 3] == 2


def test_alignment_bridges_edits():
    import numpy as np

    p = np.arange(1, 31, dtype=np.uint64)
    d = np.r_[p[:12], 99, p[13:30]].astype(np.uint64)
    (s, a), (none, _) = L.align([(p, d), (p, p[::-1].copy())], 5)
    assert s.sum() == a.sum() == 29 and not s[12] and not none.any()
