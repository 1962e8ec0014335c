import pytest
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import cache, changes, conversation, evaluation, runs, telemetry
from vellum.sources import store


def points(spark, rows):
    return spark.createDataFrame(rows, store.POINT)


def test_collections_are_made_once_and_check_their_dimension(spark, tmp_path):
    p = str(tmp_path / "c")
    assert store.create(spark, p, 2) and not store.create(spark, p, 2) and store.dimension(spark, p) == 2
    with pytest.raises(ValueError, match="holds vectors of 2"):
        store.create(spark, p, 3)
    assert store.read(spark, p).count() == 0
    a = points(spark, [("a", "d", "D", 0, "x", [1], False, [1.0, 0.0]), ("b", "d", "D", 1, "y", None, True, None), ("c", "e", None, 0, "z", [], False, [0.0, 1.0]), ("a", "d", "D", 0, "x", [1], False, [1.0, 0.0]), (None, "d", None, 0, "n", None, None, None)])
    assert store.upsert(a, p) == 3 and store.upsert(a, p) == 3
    assert sorted(r.id for r in store.read(spark, p).collect()) == ["a", "b", "c"]
    with pytest.raises(ValueError, match="vectors of 2"):
        store.upsert(points(spark, [("q", "f", None, 0, "x", None, None, [1.0])]), p)
    store.upsert(points(spark, [("a", "d", "D", 0, "new", [1], False, [1.0, 0.0])]), p)
    assert {r.id: r.content for r in store.read(spark, p).collect()} == {"a": "new", "b": "y", "c": "z"}
    store.delete_documents(spark.createDataFrame([("d",), ("none",)], "doc_id string"), p)
    assert [r.id for r in store.read(spark, p).collect()] == ["c"]
    store.recreate(spark, p, 3)
    assert store.read(spark, p).count() == 0 and store.drop(spark, p) and not store.drop(spark, p)


def test_backups_keep_the_latest(spark, tmp_path):
    t = {"t": spark.range(3).toDF("x")}
    for stamp in ("2024-01", "2024-02", "2024-03"):
        left = store.backup(spark, t, str(tmp_path / "b"), stamp, keep=2)
    assert left == ["2024-02", "2024-03"] and spark.read.parquet(str(tmp_path / "b" / "2024-03" / "t")).count() == 3


def test_older_tables_take_newer_columns(spark):
    d = store.with_columns(spark.createDataFrame([(1, "5", "z")], "id int, hits string, more string"), "id bigint, hits bigint, title string")
    assert d.dtypes == [("id", "bigint"), ("hits", "bigint"), ("title", "string"), ("more", "string")] and tuple(d.first()) == (1, 5, None, "z")


def test_runs_go_on_where_they_stopped(spark, tmp_path):
    p = str(tmp_path / "run")
    w = spark.createDataFrame([(i, c, f"q{i}") for i in range(4) for c in ("plain", "full")], "id long, config string, question string")

    def model(row):
        if row["id"] == 2:
            raise RuntimeError("busy")
        return f"{row['question']} by {row['config']}"

    assert runs.made(w, p, model) == 6 and runs.made(w, p, model) == 0
    assert runs.made(w, p, lambda r: "late") == 2
    assert {(r.id, r.config): r.said for r in runs.done(spark, p).collect()}[2, "full"] == "late" and runs.done(spark, p).count() == 8


def test_reports(spark):
    s = spark.createDataFrame([("a", 1.0, True), ("a", 0.0, False), ("b", 0.5, None)], "config string, faithfulness double, refused boolean")
    t = runs.summary_table(s, ["faithfulness", "refused"], percent=("refused",), rounds=50)
    assert {(r.metric, r.config): r.n for r in t.collect()} == {("faithfulness", "a"): 2, ("refused", "a"): 2, ("faithfulness", "b"): 1}
    text = runs.rendered(t).split("\n")
    assert text[0] == "| metric | a | b |" and text[2].startswith("| faithfulness | 0.50 [") and text[3].endswith("| - |") and "50.0%" in text[3]
    v = spark.createDataFrame([(i, v) for i, v in enumerate([5, 1, 1, 9, None, 3])], "k int, v int")
    assert tuple(runs.extremes(v, "v", "k", 2).first()) == (5, 1, 3.0, 9, [1, 2], [3, 0])
    m = evaluation.median_and_floor(spark.createDataFrame([("x", float(v)) for v in (1, 2, 3, 10)] + [("y", 7.0), ("z", None)], "g string, v double"), ["g"], "v")
    assert {tuple(r) for r in m.collect()} == {("x", 4, 2.5, 3.0), ("y", 1, 7.0, 7.0)}


def test_percentiles_of_a_long_tail(spark):
    values = [float(2**k) for k in range(40) for _ in range(k)]
    got = evaluation.percentiles(spark.createDataFrame([("g", v) for v in values], "g string, v double"), ["g"], "v", {"p50": 0.5, "p95": 0.95, "p0": 0.0}).first()
    at = lambda p: sorted(values)[round(p * (len(values) - 1))]
    assert (got.p50, got.p95, got.p0, got["max"]) == (at(0.5), at(0.95), at(0.0), max(values))


def test_stages_add_up_and_offsets_count_once():
    now = iter([0.0, 1.0, 1.5, 2.0, 2.25, 3.0, 4.0, 5.0])
    s = telemetry.Stages("r", lambda: next(now))
    with s.stage("db"):
        pass
    with pytest.raises(ValueError), s.stage("db"):
        raise ValueError
    s.since_start("first")
    s.since_start("first")
    assert s.finish() == [("r", "db", 750.0), ("r", "first", 3000.0), ("r", "total", 5000.0)]


def test_cache_state(spark):
    s = spark.createDataFrame([(1, 2, 5.0), (2, None, None)], "entry_id long, hits long, last_accessed double")
    served = spark.createDataFrame([(1, 9.0), (1, 3.0), (2, 4.0), (7, 1.0), (None, 1.0)], "entry_id long, at double")
    assert {tuple(r) for r in cache.touched(s, served).collect()} == {(1, 4, 9.0), (2, 1, 4.0)}
    meta = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    new = spark.createDataFrame([("a", None), ("c", "3"), ("c", "1")], "key string, value string")
    assert {tuple(r) for r in cache.with_meta(meta, new).collect()} == {("b", "2"), ("c", "3")}
    assert cache.current(s, "x", "x").count() == 2 and cache.current(s, None, "y").count() == 2 and cache.current(s, "x", "y").count() == 0


def test_sessions_change(spark):
    s = spark.createDataFrame([("S1", "u", "t"), ("s2", None, "x")], "id string, user_id string, title string").withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    m = conversation.messages(spark.createDataFrame([(1, " s1", "user"), (2, "s2", "user"), (3, None, "user")], "id long, session_id string, role string"))
    left, said = conversation.delete_sessions(s, m, spark.createDataFrame([("s1 ",), (None,)], "id string"))
    assert [r.id for r in left.collect()] == ["s2"] and sorted(r.id for r in said.collect()) == [2, 3]
    c = spark.sql("select 's2' as id, '  new  title ' as title, timestamp_ntz'2024-01-01' as at union all select 's2', ' ', timestamp_ntz'2024-02-01'")
    assert {r.id: r.title for r in conversation.renamed(s, c).collect()} == {"S1": "t", "s2": "new title"}
    assert [r.id for r in conversation.owned_by(s, F.lit("u")).collect()] == ["S1"]


def test_paths_and_lines(spark):
    d = spark.createDataFrame([("/d/a/../b",), ("/d/../e",), ("/d",), (None,), ("/d/./x",)], "p string")
    assert [r[0] for r in d.select(changes.inside(F.col("p"), "/d")).collect()] == [True, False, False, False, True]
    x = spark.createDataFrame([("a\nA \n\nb\n\na",), (None,)], "c string")
    assert [r[0] for r in x.select(T.unique_lines(F.col("c"))).collect()] == ["a\n\nb\n", None]
    y = spark.createDataFrame([("é",), ("é",), (None,), ("Å",)], "c string")
    assert [r[0] for r in y.select(T.nfc(F.col("c"))).collect()] == ["é", "é", None, "Å"]
