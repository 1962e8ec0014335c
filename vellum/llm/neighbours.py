"""The most similar vectors of every vector.

A tree of spherical k-means is fitted on a bounded sample (SAMPLE rows, chosen by hash) and all
rows are put into its leaves. Each vector then visits leaves best bin first: a priority queue
holds the open nodes of the tree by their cosine to the vector; the best is taken, an inner node
is replaced by its children, a leaf is visited. How many leaves are visited is calibrated: the
true neighbours of CALIBRATION vectors, none of them in the sample where there are others, are
found by brute force against all rows, and the visits are widened until the neighbours found
reach the wanted recall.

A subtree of a few leaves is a bucket, where vectors meet. From the sample it is known how many
rows live in each bucket and how many visit it; where these are more than CELL, the bucket's own
rows are dealt into slices and its visitors into parts, and each slice meets each part in a cell
of its own. So no task holds more than two CELLs of vectors, however many rows there are, and
the number of tasks follows the number of rows.

Exact copies (equal directions after rounding) are one class: classes are searched, then opened
into their entries, so that a hot group of copies costs no more than one vector.

Vectors that are null, of another length, not finite or all zero take no part. Ties go to the
smaller id. Repeated ids count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIM, K, FLOOR, RECALL = 64, 5, 0.85, 0.975
SAMPLE, CALIBRATION, LEAF, BRANCH, MAX_LEAVES, BUCKET, LEAST = 24_000, 1_200, 1_024, 12, 16_384, 8, 3
SALTS = 16
#: Rows of a bucket, and visitors, that are held at once; rows that one task of the search takes.
CELL, TASK_ROWS = 200_000, 400_000


class Tree:
    """children[i] are the first child and the number of children of node i (none of a leaf), centre[i] its unit centre, leaf[i] the number of a leaf."""

    def __init__(self, sample: np.ndarray, leaf: int, branch: int, most: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        centres, first, count = [np.zeros(sample.shape[1], np.float32)], [0], [0]
        size, up = [len(sample)], [-1]
        open_ = [(len(sample), 0, np.arange(len(sample)))]
        leaves = 1
        while open_:
            _, node, rows = open_.pop(max(range(len(open_)), key=lambda i: open_[i][0]))
            k = min(branch, max(2, len(rows) // max(1, leaf)))
            if len(rows) <= leaf or leaves + k > most:
                continue
            got, label = _kmeans(sample[rows], k, rng)
            if len(got) < 2:
                continue
            first[node], count[node] = len(centres), len(got)
            for c in range(len(got)):
                open_.append(((label == c).sum(), len(centres), rows[label == c]))
                centres.append(got[c])
                first.append(0)
                count.append(0)
                size.append(int((label == c).sum()))
                up.append(node)
            leaves += len(got) - 1
        self.centre, self.first, self.count = np.stack(centres), np.array(first), np.array(count)
        self.leaf = np.where(self.count == 0, np.cumsum(self.count == 0) - 1, -1)
        self.leaves = int((self.count == 0).sum())
        # a bucket is a subtree of about BUCKET leaves: a vector goes to it once, whatever it visits there
        top = np.full(len(size), -1)
        for i in range(len(size)):  # parents come first
            top[i] = top[up[i]] if i and top[up[i]] >= 0 else i if size[i] <= BUCKET * leaf or not count[i] else -1
        self.bucket = np.searchsorted(np.unique(top[self.count == 0]), top[self.count == 0])

    def visit(self, x: np.ndarray, visits: int) -> np.ndarray:
        """The leaves that each row of x visits, best bin first; -1 where there are no more. The queues of all rows advance in step."""
        n, width, branch = len(x), 1, int(self.count.max(initial=1))
        out = np.full((n, min(visits, self.leaves)), -1, np.int32)
        if self.leaves == 1:
            out[:, 0] = 0
            return out
        queue, score = np.zeros((n, 1), np.int32), np.zeros((n, 1), np.float32)
        done, rows = np.zeros(n, np.int64), np.arange(n)
        while len(rows):
            best = score.argmax(1)
            at = np.arange(len(rows))
            node, s = queue[at, best], score[at, best]
            score[at, best] = -np.inf
            leaf = self.leaf[node]
            hit = (leaf >= 0) & np.isfinite(s)
            out[rows[hit], done[hit]] = leaf[hit]
            done[hit] += 1
            inner = np.flatnonzero((leaf < 0) & np.isfinite(s))
            if len(inner):
                child = self.first[node[inner]][:, None] + np.arange(branch)
                none = np.arange(branch) >= self.count[node[inner]][:, None]
                child[none] = 0
                dots = np.einsum("nd,nbd->nb", x[rows[inner]], self.centre[child])
                dots[none] = -np.inf
                more_q = np.zeros((len(rows), branch), np.int32)
                more_s = np.full((len(rows), branch), -np.inf, np.float32)
                more_q[inner], more_s[inner] = child, dots
                queue, score = np.hstack([queue, more_q]), np.hstack([score, more_s])
                width = queue.shape[1]
                if width > 4 * branch + out.shape[1]:  # drop what is spent or can't be reached any more
                    keep = np.argpartition(-score, branch + out.shape[1], 1)[:, : branch + out.shape[1]]
                    queue, score = np.take_along_axis(queue, keep, 1), np.take_along_axis(score, keep, 1)
            live = (done < out.shape[1]) & np.isfinite(s)
            if not live.all():
                queue, score, done, rows = queue[live], score[live], done[live], rows[live]
        return out


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        label = (x @ c.T).argmax(1)
        order = np.argsort(label, kind="stable")
        size = np.bincount(label, minlength=k)
        at = np.r_[0, np.cumsum(size)[:-1]][size > 0]
        s = np.add.reduceat(x[order], at, axis=0)
        c = s / np.maximum(np.linalg.norm(s, axis=1, keepdims=True), 1e-12)
    label = (x @ c.T).argmax(1)
    used = np.unique(label)
    return c[used].astype(np.float32), np.searchsorted(used, label)


def _units(dim: int):
    """Directions as 16-bit integers, the largest component at their limit, in one binary value; unusable vectors are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lists = b.column(0), b.column(1)
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ok = np.flatnonzero(size == dim)
            got = lists.take(pa.array(ok))
            x = got.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
            big = np.abs(x).max(1, initial=0)
            fine = np.isfinite(big) & (big > 0)
            x = np.rint(x[fine].astype(np.float64) / big[fine][:, None] * 32767).astype(np.int16)
            keep = ids.take(pa.array(ok[fine]))
            yield pa.RecordBatch.from_arrays([keep.cast(pa.int64()), _packed(x)], ["id", "unit"])

    return run


def _packed(x: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(x)
    off = (np.arange(len(data) + 1) * data.shape[1] * data.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(off), pa.py_buffer(data)])


def _matrix(a: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of packed vectors as unit float32."""
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    if not len(a):
        return np.zeros((0, dim), np.float32)
    off = np.frombuffer(a.buffers()[1], np.int32, len(a) + 1, a.offset * 4)
    x = np.frombuffer(a.buffers()[2], np.int16, (int(off[-1]) - int(off[0])) // 2, int(off[0])).reshape(-1, dim).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1)[:, None], 1e-12)


def units(vectors: DataFrame, key: str, vector: str, dim: int = DIM) -> DataFrame:
    """(id, unit) of the usable rows."""
    return vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("v")).where(f"id is not null and size(v) = {dim}").mapInArrow(_units(dim), "id bigint, unit binary")


def _top(q: np.ndarray, x: np.ndarray, ids: np.ndarray, own: np.ndarray | None, k: int, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, id, cosine) of the k best of x for each row of q, not below floor; ties to the smaller id. x is sorted by id."""
    out_r, out_i, out_s = [], [], []
    step = max(1, 8_000_000 // max(1, len(x)))
    for a in range(0, len(q), step):
        s = q[a : a + step] @ x.T
        if own is not None:
            at = np.minimum(np.searchsorted(ids, own[a : a + step]), len(ids) - 1)
            me = np.flatnonzero(ids[at] == own[a : a + step])
            s[me, at[me]] = -2
        if floor > -1:  # few pass
            r, c = np.nonzero(s >= floor)
        else:
            c = np.argpartition(-s, min(k, s.shape[1]) - 1, 1)[:, :k] if s.shape[1] > k else np.tile(np.arange(s.shape[1]), (len(s), 1))
            r, c = np.repeat(np.arange(len(s)), c.shape[1]), c.ravel()
            keep = s[r, c] > -2
            r, c = r[keep], c[keep]
        v = s[r, c]
        order = np.lexsort((ids[c], -v, r))
        r, c, v = r[order], c[order], v[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        keep = rank < k
        out_r.append(r[keep] + a)
        out_i.append(ids[c[keep]])
        out_s.append(v[keep])
    return (np.concatenate(out_r), np.concatenate(out_i), np.concatenate(out_s)) if out_r else (np.zeros(0, int),) * 3


class Index:
    """Classes of equal directions, the fitted tree and the calibrated number of visits."""

    def __init__(self, entries: DataFrame, dim: int = DIM, k: int = K, floor: float = FLOOR, recall: float = RECALL, sample: int = SAMPLE, calibration: int = CALIBRATION, leaf: int = LEAF):
        from vellum.session import checkpointed

        self.dim, self.k, self.floor, self.spark = dim, k, floor, entries.sparkSession
        self.entries = checkpointed(entries)
        rank = F.dense_rank().over(Window.partitionBy("unit").orderBy("id"))
        head = self.entries.withColumn("n", rank).where(F.col("n") <= k + 1)  # at most k + 1 of a class go on from each task
        self.classes = checkpointed(head.groupBy("unit").agg(F.min("id").alias("id"), F.array_sort(F.collect_set("id")).alias("firsts")))
        n = self.classes.count()
        self.rows = n
        rows = self.classes.select("id", "unit")
        draw = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 40))
        edge = (1 << 40) if n <= sample else int((1 << 40) * sample / n)
        got = rows.where(draw < edge).toArrow()  # a bounded sample
        x = _matrix(got["unit"], dim)
        if n > sample:  # asked are others than those the tree was fitted on
            got = rows.where((draw >= edge) & (draw < edge + max(1, int((1 << 40) * 1.2 * calibration / n)))).toArrow()
        asked = (got["id"].to_numpy(), _matrix(got["unit"], dim))
        self.tree = Tree(x, max(1, round(leaf * len(x) / max(1, n))), BRANCH, MAX_LEAVES) if n else None
        self.sample = x
        self.visits, self.recall = self._calibrate(*asked, recall, calibration) if n else (0, 1.0)

    def _calibrate(self, ids: np.ndarray, x: np.ndarray, recall: float, calibration: int) -> tuple[int, float]:
        """The least number of visits that finds the wanted share of the true neighbours of the given vectors."""
        pick = np.random.default_rng(3).permutation(len(ids))[:calibration]
        q, own, k, floor, dim = x[pick], ids[pick], self.k, self.floor, self.dim
        tree = self.spark.sparkContext.broadcast((self.tree, q, own))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t, q, own = tree.value
            for b in batches:
                if not b.num_rows:
                    continue
                ids = b.column(0).to_numpy()
                order = np.argsort(ids)
                ids, m = ids[order], _matrix(b.column(1), dim)[order]
                r, i, s = _top(q, m, ids, own, k, floor)
                home = t.visit(m[np.searchsorted(ids, i)], 1)[:, 0] if len(i) else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(i, pa.int64()), pa.array(s, pa.float64()), pa.array(home, pa.int32())], ["q", "id", "s", "leaf"])

        true = self.classes.select("id", "unit").mapInArrow(scan, "q int, id bigint, s double, leaf int")
        best = true.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "id"))).where(F.col("n") <= k).toPandas()
        if not len(best):
            return min(self.tree.leaves, 4), 1.0
        order = self.tree.visit(q, self.tree.leaves)
        place = np.full((len(q), self.tree.leaves), self.tree.leaves)
        rows, cols = np.nonzero(order >= 0)
        place[rows, order[rows, cols]] = cols
        need = np.sort(place[best["q"].to_numpy(), best["leaf"].to_numpy()] + 1)
        at = min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)
        m = max(min(LEAST, self.tree.leaves), int(need[at]))
        return m, float((need <= m).mean())

    def _cells(self, visits: int, asked: float) -> tuple[np.ndarray, np.ndarray]:
        """Slices and parts of each bucket, as the sample has it; `asked` is the share of the rows that ask."""
        t, times = self.tree, self.rows / max(1, len(self.sample))
        to = t.visit(self.sample, visits)
        n = t.bucket.max() + 1
        home = np.bincount(t.bucket[to[:, 0]], minlength=n) * times
        r, c = np.nonzero(to >= 0)
        pair = np.unique(np.stack([r, t.bucket[to[r, c]]]), axis=1)
        come = np.bincount(pair[1], minlength=n) * times * asked
        return np.maximum(1, np.ceil(home / CELL)).astype(np.int64), np.maximum(1, np.ceil(come / CELL)).astype(np.int64)

    def search(self, queries: DataFrame | None = None, visits: int | None = None) -> DataFrame:
        """(query, id, cosine): the best k other classes of each class, or of the given classes only."""
        dim, k, floor, m = self.dim, self.k, self.floor, visits or self.visits
        everyone = queries is None
        slices, pieces = self._cells(m, 1.0 if everyone else queries.count() / self.rows)
        tree = self.spark.sparkContext.broadcast((self.tree, slices, pieces))

        def spread(visits: int, home: bool, asks: bool):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                t, slices, pieces = tree.value
                width = int(slices.max() * pieces.max())
                for b in batches:
                    x = _matrix(b.column(1), dim)
                    if not len(x):
                        continue
                    to = t.visit(x, visits)
                    r, c = np.nonzero(to >= 0)
                    to, place = to[r, c], c
                    bucket = t.bucket[to]
                    order = np.lexsort((place, bucket, r))
                    r, to, bucket, place = r[order], to[order], bucket[order], place[order]
                    at = np.flatnonzero(np.r_[True, (np.diff(r) != 0) | (np.diff(bucket) != 0)])
                    end = np.r_[at[1:], len(to)]
                    ids = b.column(0).to_numpy()[r[at]]
                    deal = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                    own = np.where(place[at] == 0, to[at], -1) if home else np.full(len(at), -1)
                    s, p = slices[bucket[at]], pieces[bucket[at]]
                    mine, part = (deal % s.astype(np.uint64)).astype(np.int64), (deal // np.uint64(1009) % p.astype(np.uint64)).astype(np.int64)
                    # as a visitor a row goes to every slice of its part, as a resident to every part of its slice
                    out = [(np.zeros(0, np.int64),) * 4]
                    if asks:
                        e = np.repeat(np.arange(len(at)), s)
                        sl = np.arange(len(e)) - np.repeat(np.cumsum(s) - s, s)
                        out.append((e, sl, part[e], np.ones(len(e), np.int64)))
                    h = np.flatnonzero(own >= 0)
                    e = np.repeat(h, p[h])
                    pt = np.arange(len(e)) - np.repeat(np.cumsum(p[h]) - p[h], p[h])
                    keep = pt != part[e] if asks else np.ones(len(e), bool)  # there it is a visitor already
                    out.append((e[keep], mine[e[keep]], pt[keep], np.zeros(int(keep.sum()), np.int64)))
                    e, sl, pt, asking = (np.concatenate(z) for z in zip(*out))
                    size = np.where(asking > 0, end[e] - at[e], 0)
                    flat = np.repeat(at[e], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), pa.array(to[flat], pa.int32()))
                    lives = np.where(sl == mine[e], own[e], -1)
                    rows = pa.array(r[at][e])
                    cell = bucket[at][e].astype(np.int64) * width + sl * int(pieces.max()) + pt
                    yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), b.column(0).take(rows), b.column(1).take(rows), pa.array(lives, pa.int32()), lists], ["bucket", "id", "unit", "home", "visits"])

            return run

        schema = "bucket bigint, id bigint, unit binary, home int, visits array<int>"
        rows = self.classes.select("id", "unit")
        sent = rows.mapInArrow(spread(m, True, True), schema) if everyone else rows.mapInArrow(spread(1, True, False), schema).unionByName(queries.select("id", "unit").mapInArrow(spread(m, False, True), schema))
        most = int(self.rows * (min(m, 3) if everyone else 1) / TASK_ROWS)
        if most > self.spark.sparkContext.defaultParallelism:
            sent = sent.repartition(most, "bucket")

        def look(t: pa.Table) -> pa.Table:
            ids, x, home = t["id"].to_numpy(), _matrix(t["unit"], dim), t["home"].to_numpy()
            v = t["visits"].combine_chunks()
            who, where = np.repeat(np.arange(len(ids)), v.value_lengths().to_numpy()), v.flatten().to_numpy()
            order = np.argsort(where, kind="stable")
            who, where = who[order], where[order]
            out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
            by = np.lexsort((ids, home))
            for leaf in np.unique(where).tolist():
                q = who[np.searchsorted(where, leaf) : np.searchsorted(where, leaf, "right")]
                base = by[np.searchsorted(home[by], leaf) : np.searchsorted(home[by], leaf, "right")]
                if len(base):
                    r, i, c = _top(x[q], x[base], ids[base], ids[q], k, floor)
                    out.append((ids[q][r], i, c))
            q, i, c = (np.concatenate(z) for z in zip(*out))
            order = np.lexsort((i, -c, q))
            q, i, c = q[order], i[order], c[order]
            keep = np.arange(len(q)) - np.searchsorted(q, q) < k
            return pa.table({"query": pa.array(q[keep], pa.int64()), "id": pa.array(i[keep], pa.int64()), "cosine": pa.array(c[keep], pa.float32())})

        found = sent.groupBy("bucket").applyInArrow(look, "query bigint, id bigint, cosine float")
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "id"))  # at most k rows a visit
        return found.withColumn("n", rank).where(F.col("n") <= k).drop("n")

    def open(self, near: DataFrame) -> DataFrame:
        """(entry, neighbour, cosine): the k best entries of each entry, from the classes' neighbours."""
        k = self.k
        many = self.classes.where(F.size("firsts") > 1).select(F.col("id").alias("class"), "unit", "firsts")
        lists = near.join(many.select(F.col("class").alias("id"), "firsts"), "id", "left").withColumn("firsts", F.coalesce("firsts", F.array("id")))
        lists = lists.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("far"), "id", "firsts"))).alias("others"))  # at most k
        one = lists.join(many, lists["query"] == many["class"], "full").select(F.coalesce("firsts", F.array("query")).alias("firsts"), "unit", F.coalesce(F.col("others"), F.expr("cast(array() as array<struct<far:float,id:bigint,firsts:array<bigint>>>)")).alias("others"))
        flat = F.expr("concat(transform(firsts, x -> struct(x as n, 1.0f as c)), flatten(transform(others, o -> transform(o.firsts, x -> struct(x as n, -o.far as c)))))")
        one = one.select("unit", "firsts", F.slice(flat, 1, 3 * k + 1).alias("best"))
        few = one.where(F.size("firsts") <= k).select(F.explode("firsts").alias("id"), "best")
        # a larger class may hold any share of the entries: its row goes to each of SALTS parts
        hot = one.where(F.size("firsts") > k).select("unit", "best", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        e = self.entries.withColumn("salt", F.pmod("id", F.lit(SALTS)).cast("int")).join(hot, ["unit", "salt"]).select("id", "best")
        e = few.unionByName(e).select("id", F.slice(F.filter("best", lambda b: b["n"] != F.col("id")), 1, k).alias("best"))
        return e.select(F.col("id").alias("entry"), F.inline("best")).select("entry", F.col("n").alias("neighbour"), F.col("c").alias("cosine"))


def similar_pairs(entries: DataFrame, floor: float = FLOOR, k: int = K, recall: float = RECALL) -> DataFrame:
    """(entry_a, entry_b), entry_a < entry_b: pairs where one is among the k best of the other and the cosine is at least floor."""
    ix = Index(entries, k=k, floor=floor, recall=recall)
    if not ix.rows:
        return entries.select(F.col("id").alias("entry_a"), F.col("id").alias("entry_b")).limit(0)
    p = ix.open(ix.search())
    return p.select(F.least("entry", "neighbour").alias("entry_a"), F.greatest("entry", "neighbour").alias("entry_b")).distinct()


def nearest(entries: DataFrame, which, k: int = K, recall: float = 0.92) -> DataFrame:
    """(entry, neighbour, cosine): the k best of any cosine for the entries that `which` names, against all entries."""
    ix = Index(entries, k=k, floor=-1.5, recall=recall)
    if not ix.rows:
        return entries.select(F.col("id").alias("entry"), F.col("id").alias("neighbour"), F.lit(0.0).cast("float").alias("cosine")).limit(0)
    asked = ix.entries.where(which)
    near = ix.search(ix.classes.join(asked.select("unit").distinct(), "unit", "left_semi"))
    return ix.open(near).join(asked.select(F.col("id").alias("entry")), "entry", "left_semi")
