import numpy as np

from vellum.operators import cache, evaluation
from vellum.plans import catalogue


def run(spark, path, name, **tables):
    for t, df in tables.items():
        df.write.parquet(f"{path}/{t}.parquet")
    return catalogue.queries()[name](spark, str(path))


def test_every_user_message_gets_a_title(spark, tmp_path):
    said = ["Học phí là bao nhiêu?", "Học\u00a0phí\u3000là\u2009gì 😊", "Ｈọｃ ｐｈí", "Нọc phí", "a\u200bb", "😊" * 70, "x" * 61, "", None]
    m = spark.createDataFrame([*((i, "s", "user", c) for i, c in enumerate(said)), (0, "s", "user", said[0]), (90, "s", "model", "😊")], "id long, session_id string, role string, content string")
    got = {r.id: r.title for r in run(spark, tmp_path, "fallback_titles", chat_messages=m).collect()}
    assert got == {0: said[0], 1: "Học phí là gì 😊", 2: said[2], 3: said[3], 4: said[4], 5: "😊" * 60 + "...", 6: "x" * 60 + "...", 7: ""}


def test_sweep_takes_the_nearest_other_entry(spark, tmp_path):
    at = lambda *x: [*map(float, x), *[0.0] * (64 - len(x))]
    rows = [
        (10, "Học phí MA101?", '["a", "b"]', at(1)), (20, "học phí  ma101?", '["c"]', at(2)), (31, "Which room?", '["b"]', at(0, 1)), (33, "Which hall?", '["x", "b"]', at(0, 1, 0.1)),
        (50, "One", '["p"]', at(0, 0, 0, 1)), (57, "Two", '["q"]', at(0, 0, 0, 1, 0.8)), (60, "Three", "[", at(0, 0, 0, 0, 0, 1)), (61, "Zero", "[]", at(0)), (62, "Null", None, None), (63, "Short", None, [1.0]), (64, "Nan", None, at(float("nan"))),
    ]
    s = spark.createDataFrame(rows, "entry_id long, query string, sources string, vector array<float>").selectExpr("*", "lower(query) as normalized_query")
    got = {(r.threshold, r.kind): (r.n, r.hits, r.guarded_hits) for r in run(spark, tmp_path, "threshold_sweep", semantic_cache=s).collect()}
    assert {k: v for k, v in got.items() if k[0] == 0.5} == {(0.5, "same_text"): (2, 2, 2), (0.5, "common_sources"): (2, 2, 0), (0.5, "other_sources"): (3, 2, 0)}
    assert {k: v for k, v in got.items() if k[0] == 0.9} == {(0.9, "same_text"): (2, 2, 2), (0.9, "common_sources"): (2, 2, 0), (0.9, "other_sources"): (3, 0, 0)}


def test_nearest_other_equals_all_pairs_whatever_the_blocks(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 64)).astype(np.float32)
    x[250:] = x[:50]
    c = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    c = c @ c.T
    np.fill_diagonal(c, -2)
    want = {i: int(np.flatnonzero(r >= r.max() - 1e-6)[0]) for i, r in enumerate(c)}
    s = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "entry_id long, vector array<float>")
    for block in (65_536, 70):
        got = cache.nearest_other(s, block=block).collect()
        assert {r.entry_id: r.other_id for r in got} == want and all(abs(r.cosine - c[r.entry_id, r.other_id]) < 2e-6 for r in got)
    assert cache.nearest_other(s.limit(1)).count() == 0 and cache.nearest_other(s.limit(0)).count() == 0


def test_interval_of_answers_takes_all_rounds(spark, tmp_path):
    s = spark.range(500).selectExpr("id as entry_id", "repeat('x', cast(1 + pmod(xxhash64(id), 97) as int)) as answer")
    got = run(spark, tmp_path, "bootstrap_interval", semantic_cache=s).first()
    want = evaluation.bootstrap(s.selectExpr("cast(length(answer) as double) as value"), rounds=2000).first()
    assert (got.mean, got.low, got.high, got.n) == (round(want["mean"], 6), round(want.low, 6), round(want.high, 6), 500)


def test_bootstrap_draws_equal_rows_apart(spark):
    v = spark.range(800).selectExpr("if(id < 400, 'a', null) as g", "cast(id % 10 as double) as value").unionByName(spark.createDataFrame([("b", 3.0)], "g string, value double"))
    got = {r.g: r for r in evaluation.bootstrap(v, by=["g"]).where("g is not null").collect()}
    se = (8.25 / 400) ** 0.5  # of a mean of 400 draws
    assert abs(got["a"].low - (4.5 - 1.96 * se)) < 0.25 * se and abs(got["a"].high - (4.5 + 1.96 * se)) < 0.25 * se
    assert (got["b"].low, got["b"].high, got["b"].n) == (3.0, 3.0, 1)


def test_short_passages_have_truth(spark, tmp_path):
    texts = ["the fee for the course is due in may", "opening hours", "nothing here", "the subfee form"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    e = spark.createDataFrame([(1, "when is the fee due", "fee for the course"), (2, "opening hours", "opening hours"), (3, "fee", "fee"), (4, "nothing", "elsewhere only"), (5, "form", None), (6, "course fee due", texts[0])], "item_id long, question string, passage string")
    got = {r.method: r for r in run(spark, tmp_path, "retrieval_metrics", documents=d, eval_items=e).collect()}
    assert {k: r.queries for k, r in got.items()} == {"bm25": 4, "overlap": 4}
    assert got["bm25"].hit_k == 1.0 and got["bm25"].recall_k == 0.875
