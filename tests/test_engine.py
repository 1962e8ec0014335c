import json
import math
import random

import pytest
from pyspark.sql import functions as F

from vellum.functions import intent
from vellum.operators import cache, conversation, evaluation, memory, models, retrieval, segments, telemetry


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_windows_in_buckets_equal_plain_windows(spark):
    random.seed(3)
    data = [(random.choice("aab"), i, random.choice([None, "x", "y"]) and f"v{i}") for i in random.sample(range(400), 120)]
    df = spark.createDataFrame(data, "k string, o long, v string")
    want, last = {}, {}
    for k, o, v in sorted(data, key=lambda r: (r[0], r[1])):
        want[k, o] = last.get(k)
        last[k] = v if v is not None else last.get(k)
    for width in (7, 50, 10_000):
        got = segments.last_before(df, ["k"], "o", F.col("v"), "p", width)
        assert {(r.k, r.o): r.p for r in got.collect()} == want
        pos = segments.positions(df, ["k"], "o", "n", width).collect()
        assert all([r.n for r in sorted((x for x in pos if x.k == k), key=lambda r: r.o)] == list(range(1, 1 + sum(d[0] == k for d in data))) for k in "ab")


def test_question_before_is_an_asof_join(spark):
    m = spark.createDataFrame([(1, "S ", "user", "q1"), (2, "s", "bot", "a1"), (3, "s", "Model", "a2"), (4, "s", "User", "q2"), (5, "s", "model", "a3"), (6, "t", "model", "a4"), (5, "s", "model", "a3"), (7, None, "model", "x")], "id long, session_id string, role string, content string").withColumn("created_at", F.lit(None).cast("timestamp_ntz"))
    got = conversation.question_before(conversation.messages(m), width=2)
    assert rows(got) == {(2, "s", "q1"), (3, "s", "q1"), (5, "s", "q2"), (6, "t", None)}


def test_history_keeps_head_and_latest_run(spark):
    m = spark.createDataFrame([(i, "s", "user", "x" * 40, None) for i in range(10)] + [(99, "t", "user", None, None)], "id long, session_id string, role string, content string, created_at timestamp_ntz")
    m = conversation.messages(m)
    assert {r.id for r in conversation.trim_history(m, budget=50).collect()} == {0, 1, 7, 8, 9, 99}
    assert conversation.trim_history(m, budget=1000).count() == 11


def test_sources_of_every_form(spark):
    df = spark.createDataFrame([('["a","b"]',), ('{"sources":["c"],"t":1}',), ("d|e|",), ("[broken",), (None,), ("",), ('{"x":1}',)], "c string")
    assert [r[0] for r in df.select(conversation.source_list(F.col("c"))).collect()] == [["a", "b"], ["c"], ["d", "e"], [], [], [], []]


def test_followups_are_rewritten(spark):
    df = spark.createDataFrame([("Mục 2 là gì?", "ans", "q"), ("Học phí bao nhiêu?", "ans", "q"), ("giải thích rõ hơn", None, "q"), ("giải thích rõ hơn", None, None)], "q string, a string, b string")
    got = [r[0] for r in df.select(conversation.rewritten(F.col("q"), F.col("a"), F.col("b"))).collect()]
    assert got == ["Question: Mục 2 là gì?\nEarlier question: q\nEarlier answer: ans", "Học phí bao nhiêu?", "Question: giải thích rõ hơn\nEarlier question: q", "giải thích rõ hơn"]


def test_feedback_days_are_dense(spark):
    f = spark.sql("select 1 as id, 5 as message_id, 'LIKE' as rating, null as comment_text, timestamp_ntz'2024-01-01 10:00:00' as created_at union all select 2, 5, 'dislike', null, timestamp_ntz'2024-01-03 10:00:00'")
    assert [(r.like, r.dislike) for r in conversation.feedback_by_day(f).orderBy("day").collect()] == [(1, 0), (0, 0), (0, 1)]
    assert conversation.feedback_by_day(f.limit(0)).count() == 0
    assert [r.rating for r in conversation.latest_ratings(f).collect()] == ["dislike"]


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, "c"), (4, None)], "doc_id long, text string")
    q = spark.createDataFrame([(9, "a a"), (8, None)], "query_id long, query string")
    n, avg, idf = 4, 6 / 4, math.log((4 - 1 + 0.5) / 1.5 + 1)
    want = 2 * idf * 2 * 2.5 / (2 + 1.5 * (1 - 0.75 + 0.75 * 3 / avg))
    (r,) = retrieval.bm25(docs, q).collect()
    assert (r.query_id, r.doc_id) == (9, 1) and r.score == pytest.approx(want, abs=1e-5) and n == 4


def test_lists_equal_all_pairs_ranked(spark, monkeypatch):
    rng = random.Random(6)
    text = lambda n: " ".join(f"w{min(rng.randrange(1, 60), rng.randrange(1, 60))}" for _ in range(n))
    docs = spark.createDataFrame([(f"d{i:03}", text(rng.randrange(0, 30))) for i in range(200)] + [("x", None), ("y", "")], "doc_id string, text string")
    q = spark.createDataFrame([(i, text(4)) for i in range(25)] + [(3, "w2 w2"), (90, None), (91, "unseen"), (92, "")], "query_id int, query string")
    want = {}
    for m in ("bm25", "sparse", "overlap"):
        s = retrieval.matches(docs, q).select("query_id", "doc_id", F.col(m).alias("score"))
        want[m] = {(m, r.query_id, r["rank"], r.doc_id, r.score) for r in retrieval.ranked(s, 7).collect()}
    for terms, cells in ((200_000, 4_000_000), (11, 90)):
        monkeypatch.setattr(retrieval, "TERMS", terms)
        monkeypatch.setattr(retrieval, "CELLS", cells)
        got = retrieval.lists_of(docs, q, ["bm25", "sparse", "overlap"], 7)
        assert {(r.method, r.query_id, r["rank"], r.doc_id, r.score) for r in got.collect()} == set.union(*want.values())
    assert retrieval.lists_of(docs.limit(0), q, ["bm25"], 3).count() == 0 and retrieval.lists_of(docs, q.limit(0), ["bm25"], 3).count() == 0


def test_fusion_ignores_order_and_needs_no_common_list(spark):
    lists = [("a", 1, 10, 3.0, 1), ("a", 1, 11, 2.0, 2), ("b", 1, 11, 5.0, 1), ("b", 1, 12, 5.0, 2)]
    schema = "method string, query_id long, doc_id long, score double, rank int"
    one = rows(retrieval.rrf(spark.createDataFrame(lists, schema), 2))
    assert one == rows(retrieval.rrf(spark.createDataFrame(lists[::-1], schema), 2))
    assert dict((d, s) for _, d, s in one)[11] == pytest.approx(1 / 4 + 1 / 3, abs=1e-8)
    s = dict((d, s) for _, d, s in rows(retrieval.score_fusion(spark.createDataFrame(lists, schema), {"a": 0.5, "b": 0.5})))
    assert s == {10: 0.5, 11: 0.5, 12: 0.5}


def test_threshold_keeps_all_rather_than_none(spark):
    d = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.1), (2, 3, 0.1), (2, 4, 0.05)], "query_id int, doc_id int, score double")
    assert rows(retrieval.threshold(d).select("doc_id")) == {(1,), (3,), (4,)}


def test_rollup_inserts_summaries(spark):
    c = spark.createDataFrame([(1, "d", "T > 1. a\nx"), (2, "d", "T > 2. b\nx"), (3, "d", "T > 3. c\nx"), (4, "d", "Summary long text"), (5, "d", "Sum"), (6, "e", "other")], "chunk_id int, doc_id string, content string")
    h = spark.createDataFrame([(9, 1, 1), (9, 2, 2), (9, 6, 3), (9, 3, 4), (8, 6, 1)], "query_id int, chunk_id int, rank int")
    got = {}
    for r in retrieval.rollup(h, c).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == {9: [1, 4, 5, 2], 8: [6]}


def test_metrics(spark):
    r = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (2, 7, 3), (3, 8, 1)], "query_id int, doc_id int, rank int")
    t = spark.createDataFrame([(1, 6), (2, 7), (4, 1), (4, 2)], "query_id int, doc_id int")
    (m,) = retrieval.metrics(r, t, k=2, deep=3).collect()
    assert (m.queries, m.hit_k, m.mrr_k, m.hit_2k, m.recall_k, m.precision_k) == (3, 0.333333, 0.166667, 0.666667, 0.333333, 0.166667)
    assert m.mrr_deep == pytest.approx((1 / 2 + 1 / 3) / 3, abs=1e-5)


def test_dense_skips_unusable_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 0.1]), (4, None), (5, [0.0, 0.0]), (6, [1.0]), (7, [float("nan"), 1.0])], "doc_id int, vector array<double>")
    q = spark.createDataFrame([(9, [5.0, 0.0]), (8, None)], "query_id int, vector array<double>")
    assert [(r.query_id, r.doc_id, r.rank) for r in retrieval.dense(v, q, 2).orderBy("rank").collect()] == [(9, 1, 1), (9, 3, 2)]
    assert retrieval.dense(v, q.limit(0), 2).count() == 0


def test_pipeline_of_many_queries_is_exact_without_lists_of_every_task(spark, monkeypatch):
    from vellum.operators import fused

    rng = random.Random(5)
    said = lambda: None if rng.random() < 0.05 else " ".join(rng.choice(["the", "exam", "fee", "room", f"k{rng.randrange(40)}", f"n{rng.randrange(400)}"]) for _ in range(rng.randrange(8)))

    def vector():
        if rng.random() < 0.1:
            return rng.choice([None, [0.0, 0.0, 0.0], [1.0, float("nan"), 0.0], [1.0, float("inf"), 0.0], [1.0], []])
        return [float(rng.randrange(-2, 3)) for _ in range(3)]

    p = spark.createDataFrame([(f"d{i}", said(), vector()) for i in range(700)], "doc_id string, text string, vector array<float>")
    q = spark.createDataFrame([(i, said(), vector()) for i in range(120)], "query_id bigint, query string, vector array<float>")
    run = lambda: sorted(map(tuple, retrieval.pipeline(p, q, (2, 60), depth=20, dim=3, least=0.5).collect()))
    want = run()
    for name, value in (("BLOCK", 16), ("PIECE", 150), ("FREQUENT", 5)):
        monkeypatch.setattr(fused, name, value)
    monkeypatch.setattr(retrieval, "MANY", 100)
    for name in ("dense", "lists_of"):  # these give rows of every task for every query
        monkeypatch.setattr(retrieval, name, lambda *_: 1 / 0)
    assert want and run() == want
    assert retrieval.pipeline(p.limit(0), q, depth=20, dim=3).count() == 0


def test_pipeline_joins_dense_and_sparse_lists(spark):
    p = spark.createDataFrame([(1, "fees of the course", [1.0, 0.0]), (2, "opening hours", [0.9, 0.1]), (3, None, [0.0, 1.0]), (4, "course", None)], "doc_id int, text string, vector array<double>")
    q = spark.createDataFrame([(7, "course fees", [1.0, 0.0]), (8, "hours", None), (9, None, None)], "query_id int, query string, vector array<double>")
    got = [(r.constant, r.query_id, r.doc_id, r.rank) for r in retrieval.pipeline(p, q, (2, 60), dim=2, least=0.5).orderBy("constant", "query_id", "rank").collect()]
    assert got == [(c, *x) for c in (2, 60) for x in ((7, 1, 1), (7, 4, 2), (8, 2, 1))]
    assert retrieval.pipeline(p.limit(0), q, dim=2).count() == 0
    c = spark.createDataFrame([("a", "d", "D.pdf", "fees of the course", False), ("b", "e", None, "library hours", True), ("c", "e", "x.png", " ", None)], "chunk_id string, doc_id string, doc_name string, content string, is_table boolean")
    out = {r.query_id: (r.context, r.sources, r.has_table) for r in retrieval.answer_context(c, q.select("query_id", "query"), least=0.5).collect()}
    assert out[7] == ("[D.pdf]\nfees of the course", ["D.pdf"], False) and set(out) == {7, 8}


def test_lookup_tiers_and_guards(spark):
    s = spark.createDataFrame([(1, "Học phí kỳ 1 bao nhiêu", [1.0, 0.0], 1.0), (2, "học phí kỳ 2 bao nhiêu", [1.0, 0.0], 1.0)], "entry_id long, query string, vector array<double>, created_at double")
    q = spark.createDataFrame([(1, " HỌC PHÍ kỳ 1  bao nhiêu", None), (2, "cho em hỏi học phí kỳ 2 bao nhiêu ạ", None), (3, "bao nhiêu học phí kỳ 1", [1.0, 0.1]), (4, "bao nhiêu học phí kỳ 3", [1.0, 0.0]), (5, "bao nhiêu học phí kỳ 2", [0.0, 1.0]), (6, None, None)], "query_id long, query string, vector array<double>")
    assert rows(cache.lookup(q, s)) == {(1, 1, "exact"), (2, 2, "canonical"), (3, 1, "semantic")}
    assert rows(cache.lookup(q, s, now=8.0, ttl=7)) == rows(cache.lookup(q, s))


def test_expired_entries_serve_no_tier(spark):
    v = [1.0, 0.0]
    s = spark.createDataFrame([(1, "Học phí kỳ 1 bao nhiêu", v, 1.0), (2, "học phí kỳ 1 bao nhiêu", v, 50.0), (3, "học phí kỳ 2 bao nhiêu", v, 1.0), (4, "học phí kỳ 4 bao nhiêu", v, None)], "entry_id long, query string, vector array<double>, created_at double")
    q = spark.createDataFrame([(1, "học phí kỳ 1 bao nhiêu", v), (2, "cho em hỏi học phí kỳ 2 bao nhiêu ạ", v), (3, "bao nhiêu học phí kỳ 2", v), (4, "học phí kỳ 4 bao nhiêu", v), (5, "bao nhiêu học phí kỳ 1", v), (6, "bao nhiêu học phí kỳ 1", [0.0, 0.0]), (7, "bao nhiêu học phí kỳ 1", None), (8, "bao nhiêu học phí kỳ 1", [1.0])], "query_id long, query string, vector array<double>")
    assert rows(cache.lookup(q, s, now=60.0, ttl=20)) == {(1, 2, "exact"), (5, 2, "semantic")}
    assert rows(cache.lookup(q, s.limit(0))) == set()


def test_victims_are_the_least_used(spark):
    data = [(i, i % 3 if i % 5 else None, None if i % 7 == 0 else float(i * 977 % 400) * 60) for i in range(60)]
    s = spark.createDataFrame(data, "entry_id long, hits long, last_accessed double")
    low = lambda x: -1 if x is None else x
    order = [r[0] for r in sorted(data, key=lambda r: (low(r[1]), low(r[2]), r[0]))]
    for size in (0, 1, 20, 47, 59, 60, 99):
        assert {r.entry_id for r in cache.victims(s, size).collect()} == set(order[: max(0, 60 - size)])


def test_put_evict_and_expire(spark):
    s = spark.createDataFrame([(1, "a", "a", "answer long enough", 1.0, 5.0, 3), (2, "b", "b", "answer long enough", 2.0, 1.0, 0), (3, "c", "c", "answer long enough", 3.0, 0.5, 0)], "entry_id long, query string, normalized_query string, answer string, created_at double, last_accessed double, hits long")
    new = spark.createDataFrame([(4, "a", "a", "another long answer", 9.0, 9.0, 0), (5, "d", "d", "short", 9.0, 9.0, 0), (6, " ", "", "long enough answer", 9.0, 9.0, 0)], s.schema)
    assert {r.entry_id for r in cache.put(s, new).collect()} == {4, 2, 3}
    assert {r.entry_id for r in cache.victims(s, 2).collect()} == {3}
    assert cache.victims(s, 9).count() == 0
    assert {r.entry_id for r in cache.warm(s, 10.0, size=2, ttl=8.5).collect()} == {2}
    assert rows(cache.without_answers(s, s.where("entry_id = 1").select("answer")).select("entry_id")) == set()


def test_cosine_and_unit(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), (None, [1.0]), ([float("nan")], [1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in df.select(cache.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0, 0.0]
    assert [r[0] and [round(x, 4) for x in r[0]] for r in df.select(cache.unit(F.col("a"))).collect()] == [[0.6, 0.8], None, [1.0], None, None]


def test_newest_files_stay(spark):
    f = spark.sql("select * from values ('a', 5L, timestamp'2024-01-01'), ('b', 5L, timestamp'2024-01-02'), ('c', 5L, timestamp'2024-01-02 01:00:00') as t(name, size, changed)")
    assert {r.name for r in cache.keep_newest(f, 12).collect()} == {"b", "c"}
    assert {r.name for r in cache.keep_newest(f, 5).collect()} == {"c"}


def test_judgments(spark):
    good = '```json\n{"claims":[{"text":"a","supported":true},{"text":"b","supported":"yes"},5],"answer_relevance":9,"refused":"no","context_sufficient":true,"key_facts":[{"fact":"f","status":"covered"},{"fact":"g","status":"odd"}]}\n```'
    df = spark.createDataFrame([(good,), ("{broken",), ("[1]",), (None,)], "c string")
    a, *rest = [r[0] for r in df.select(evaluation.judgment(F.col("c"))).collect()]
    assert rest == [None] * 3
    assert ([(c.text, c.supported) for c in a.claims], a.answer_relevance, a.refused, a.context_sufficient, [(f.fact, f.status) for f in a.key_facts]) == ([("a", True)], 5, None, True, [("f", "covered")])


def test_scores_and_summary(spark):
    j = json.dumps({"claims": [{"text": "a", "supported": True}, {"text": "b", "supported": False}], "answer_relevance": 3, "context_sufficient": True, "refused": False, "key_facts": [{"fact": "f", "status": "contradicted"}]})
    df = spark.createDataFrame([(1, "theo Điều 5", j, ["Điều 4"], True, False), (2, "chưa có thông tin", None, None, False, True)], "id int, answer string, raw string, contexts array<string>, has_facts boolean, expect_refusal boolean")
    s = evaluation.item_scores(df.withColumn("judgment", evaluation.judgment(F.col("raw"))))
    one = {r.id: r for r in s.collect()}
    assert (one[1].faithfulness, one[1].answer_relevance, one[1].correctness, one[1].contradicted, one[1].wrong_articles, one[2].refused) == (0.5, 0.5, 0.0, True, [5], True)
    (m,) = evaluation.summary(s, []).collect()
    assert (m.refusal_recall, m.n_refusal_recall, m.false_refusal_rate, m.wrong_citation_rate, m.n_correctness) == (1.0, 1, 0.0, 1.0, 1)


def test_percentiles_round_half_to_even(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (10, 20, 30, 40, 50)] + [("b", 7.0)] * 3 + [("c", None)], "s string, v double")
    assert rows(evaluation.percentiles(df, ["s"], "v", {"p50": 0.5, "p95": 0.95})) == {("a", 5, 50.0, 30.0, 50.0), ("b", 3, 7.0, 7.0, 7.0)}
    random.seed(5)
    vals = [random.gauss(0, 9) for _ in range(501)]
    got = evaluation.percentiles(spark.createDataFrame([("x", v) for v in vals], "s string, v double"), ["s"], "v", {"p": 0.9}).first().p
    assert got == sorted(vals)[round(0.9 * 500)]


def test_kappa_edges(spark):
    df = spark.createDataFrame([(True, True), (True, True)], "a boolean, b boolean")
    assert rows(evaluation.agreement(df, "a", "b")) == {(2, 1.0, 1.0)}
    df = spark.createDataFrame([(True, False), (False, True), (True, None)], "a boolean, b boolean")
    assert rows(evaluation.agreement(df, "a", "b")) == {(2, 0.0, -1.0)}


def test_bootstrap_covers_the_mean(spark):
    df = spark.range(400).select("id", (F.col("id") % 10).cast("double").alias("value"))
    r = evaluation.bootstrap(df, rounds=300).first()
    assert r.mean == 4.5 and r.low < 4.5 < r.high and 0.3 < r.high - r.low < 0.9
    assert evaluation.bootstrap(df, rounds=300).first() == r


def test_rate_limit_does_not_log_rejected_hits(spark):
    ts = [0, 10, 20, 61, 70, 75, 500, 501, 502]
    e = spark.createDataFrame([(1, i, t) for i, t in enumerate(ts)] + [(2, 50, 5)], "user_id int, event_id int, s long").select("user_id", "event_id", F.timestamp_seconds("s").alias("ts"))
    got = {r.event_id: r.accepted for r in telemetry.rate_limited(e, 2, 60).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: False, 5: True, 6: True, 7: True, 8: False, 50: True}


def test_memories_keep_the_latest(spark):
    m = spark.createDataFrame([("u", "em là K63 ngành CNTT", 1), ("u", "thật ra khóa 64, mục tiêu GPA là 3.2", 2), ("default_user", "K60", 3), ("v", None, 4), ("v", "học lại môn giải tích 1, cần tư vấn", 5)], "user_id string, content string, id long").withColumn("created_at", F.timestamp_seconds("id"))
    got = memory.remembered(m)
    assert {(r.user_id, r.key, r.value) for r in got.collect()} == {("u", "cohort", "K64"), ("u", "subject", "Công nghệ thông tin"), ("u", "target", "3.2"), ("v", "retake", "Giải Tích 1")}
    assert memory.prompt(got).where("user_id = 'v'").first().prompt == "- Môn cần cải thiện: Giải Tích 1"


def test_owner_ids(spark):
    df = spark.createDataFrame([(" ", "q"), ("a b", "q"), ("x", None), ("default_user", None), (None, None)], "h string, q string")
    assert [r[0] for r in df.select(memory.owner(F.col("h"), F.col("q"))).collect()] == ["q", None, "x", None, None]


def test_followup_topics(spark):
    t = spark.createDataFrame([("fee", ["học phí"], ["Hạn nộp?", "Miễn giảm?"]), ("dorm", ["ktx"], ["Giá phòng?"])], "topic string, keywords array<string>, questions array<string>")
    a = spark.createDataFrame([(1, "Học phí bao nhiêu", ["ktx.pdf"]), (2, "khác", [])], "id int, question string, sources array<string>")
    assert [(r.id, r.question) for r in memory.followups(a, t).orderBy("id", "place").collect()] == [(1, "Hạn nộp?"), (1, "Miễn giảm?")]


def test_embedding_is_once_per_key_and_deterministic(spark):
    df = spark.createDataFrame([(1, "a b"), (2, " A  b "), (3, None), (4, "")], "id int, t string")
    r = {x.id: x for x in models.embed(df, "t").collect()}
    assert r[1].dense == r[2].dense and r[3].dense is None and r[4].dense is None and abs(sum(x * x for x in r[1].dense) - 1) < 1e-5
    p = models.embed(df, "t").where("dense is not null").select(F.col("id").alias("doc_id"), "sparse")
    q = p.where("doc_id = 1").select(F.col("doc_id").alias("query_id"), "sparse")
    assert rows(models.sparse_search(p, q, 5)) == {(1, 1, 2.0, 1), (1, 2, 2.0, 2)}


def test_clean_sets_unite_labels(spark):
    df = spark.createDataFrame([(2, "Hỏi gì ?", ["b"]), (1, " hỏi  gì", ["a"]), (3, "khác", None), (4, " ", ["x"])], "id int, question string, truth array<string>")
    assert {(r.id, tuple(r.truths)) for r in evaluation.clean_set(df).collect()} == {(1, ("a", "b")), (3, ())}


def test_intents(spark):
    df = spark.createDataFrame([("Xem ảnh này",), ("Tóm tắt giúp",), ("học phí các ngành",), (None,)], "q string")
    got = [tuple(r) for r in df.select(intent.about_image(F.col("q")), intent.about_its_text(F.col("q")), intent.wants_table(F.col("q"))).collect()]
    assert got == [(True, False, False), (False, True, False), (False, False, True), (False, False, False)]


def test_item_of_an_answer(spark):
    a = "Mở đầu\nÝ 1: nộp hồ sơ tại phòng\nÝ 2: đóng lệ phí\nhạn 15/9"
    df = spark.createDataFrame([("ý 2 là gì", a), ("mục 15 nói gì", a), ("giải thích thêm", a), ("ý 7", "ngắn"), ("x", None)], "q string, a string")
    assert [r[0] for r in df.select(intent.referred_item(F.col("q"), F.col("a"))).collect()] == ["Ý 2: đóng lệ phí", "hạn 15/9", "Ý 1: nộp hồ sơ tại phòng\nÝ 2: đóng lệ phí", None, None]


def test_small_helpers(spark):
    df = spark.createDataFrame([("[BẢNG 1] Nguồn: Quy chế.pdf, ",), ("context",), ("x.PNG",), (None,)], "c string")
    assert [r[0] for r in df.select(intent.source_title(F.col("c"))).collect()] == ["Quy chế.pdf", "", "", ""]
    one = spark.range(1).select(intent.sigmoid(F.lit(0.0)).alias("a"), intent.sigmoid(F.lit(99.0)).alias("b"), intent.sigmoid(F.lit(-99.0)).alias("c"), intent.replay(F.lit("a b c d e"), 2).alias("d"), intent.audio_error(F.lit(bytearray(b"")), 5).alias("e"), intent.audio_error(F.lit(bytearray(b"RIFF1234WAVEfmt ")), 99).alias("f"), intent.audio_error(F.lit(bytearray(b"RIFF1234WAVEfmt ")), 5).alias("g"))
    r = one.first()
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g) == (0.5, 1.0, 0.0, ["a b c ", "d e"], "empty", None, "too large")


def test_variants_and_latent(spark):
    lists = [(m, 1, d, 1.0 / r, r) for m in ("dense", "sparse") for r, d in enumerate((5, 6, 7) if m == "dense" else (7, 6, 8), 1)]
    v = retrieval.variants(spark.createDataFrame(lists, "method string, query_id long, doc_id long, score double, rank int"))
    top = {r.variant: r.doc_id for r in v.where("rank = 1").collect()}
    assert len(top) == 12 and top["dense"] == 5 and top["sparse"] == 7 and top["rrf k=2"] == 7
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["fee course pay", "fee pay money", "dorm room bed", "room bed key", None])], "doc_id long, text string")
    q = spark.createDataFrame([(9, "pay fee"), (8, "bed room")], "query_id long, query string")
    got = {(r.query_id, r.doc_id) for r in retrieval.latent(docs, q, 2, dims=3).collect()}
    assert got == {(9, 0), (9, 1), (8, 2), (8, 3)}
