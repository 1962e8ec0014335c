import numpy as np

from vellum.llm import neighbours as N


def data(n=1500, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(60, 64))
    x = np.r_[centre[rng.integers(0, 60, n // 2)] + 0.25 * rng.normal(size=(n // 2, 64)), rng.normal(size=(n - n // 2, 64))]
    return x * rng.uniform(0.5, 3, size=(n, 1))


def brute(x, ids, k, floor):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    g = u @ u.T
    np.fill_diagonal(g, -2)
    out = set()
    for i, row in enumerate(g):
        for j in np.lexsort((ids, -np.round(row, 5)))[:k]:
            if row[j] >= floor:
                out.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return out


def test_recall_against_brute_force(spark):
    x = data()
    ids = np.arange(len(x)) * 3
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "entry_id long, vector array<double>")
    e = N.units(df, "entry_id", "vector")
    ix = N.Index(e, leaf=100)
    assert ix.tree.leaves > 8 and ix.recall >= 0.97
    want = brute(x, ids, 5, N.FLOOR)
    got = {(r.entry_a, r.entry_b) for r in N.similar_pairs(e).collect()}
    assert len(want) > 500 and len(got & want) / len(want) >= 0.95 and len(got - want) <= 0.05 * len(want)


def test_nearest_of_any_cosine(spark):
    x = data(800, 2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "entry_id long, vector array<double>")
    r = N.nearest(N.units(df, "entry_id", "vector"), "id % 100 = 0").collect()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hit = sum(b in set(np.argsort(-np.where(np.arange(800) == a, -2, u @ u[a]))[:5]) for a, b, _ in r)
    assert len(r) == 40 and hit >= 36


def test_hot_copies_faulty_vectors_and_repeated_rows(spark):
    v = [1.0] + [0.0] * 63
    w = [0.95, 0.3] + [0.0] * 62
    rows = [(i, v) for i in range(10, 40)] + [(10, v), (1, w), (2, None), (3, []), (4, [1.0] * 48), (5, [0.0] * 64), (6, [float("nan")] + [1.0] * 63), (7, [float("inf")] + [0.0] * 63), (None, v), (8, [-x for x in v]), (9, [x * 3e30 for x in v])]
    df = spark.createDataFrame(rows, "entry_id long, vector array<double>")
    got = {(r.entry_a, r.entry_b) for r in N.similar_pairs(N.units(df, "entry_id", "vector")).collect()}
    first = [9, 10, 11, 12, 13, 14]
    want = {(min(a, b), max(a, b)) for a in [9, *range(10, 40)] for b in [f for f in first if f != a][:5]} | {(1, b) for b in first[:5]}
    assert got == want
    assert N.similar_pairs(N.units(df.limit(0), "entry_id", "vector")).count() == 0


def test_best_bin_first_ends_with_every_leaf():
    x = data(600, 3).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    t = N.Tree(x, 20, 6, 1000)
    order = t.visit(x[:50], t.leaves)
    assert all(sorted(r.tolist()) == list(range(t.leaves)) for r in order)
    assert N.Tree(x[:1], 20, 6, 1000).visit(x[:3], 4).tolist() == [[0]] * 3


def test_cells_give_what_whole_buckets_give(spark, monkeypatch):
    x = data(900, 4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "entry_id long, vector array<double>")
    ix = N.Index(N.units(df, "entry_id", "vector"), leaf=100)
    rows = lambda d: {(r.query, r.id) for r in d.collect()}
    some = ix.classes.where("id % 7 = 0")
    whole, few = rows(ix.search()), rows(ix.search(some))
    monkeypatch.setattr(N, "CELL", 40)
    monkeypatch.setattr(N, "TASK_ROWS", 50)
    slices, parts = ix._cells(ix.visits, 1.0)
    assert slices.max() > 1 and parts.max() > 1
    assert rows(ix.search()) == whole and rows(ix.search(some)) == few
