"""The cache of answered questions as tables: lookups, expiry, eviction, invalidation.

A store has entry_id, query, normalized_query, answer, vector, created_at, last_accessed (epoch
seconds) and hits. Times are parameters, so results are the same on every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as T

TTL, SIZE, THRESHOLD = 7 * 24 * 3600, 1000, 0.90
LEAST_ANSWER, PARTS = 10, 8


def normalized(c: Column) -> Column:
    """Questions as they are compared: composed, lower case, single blanks."""
    return T.question_norm(c)


def expired(created: Column, now: Column | float, ttl: float | None = TTL) -> Column:
    """Whether an entry is older than ttl; never without one."""
    return F.lit(False) if not ttl else (F.lit(now) if not isinstance(now, Column) else now) - created > F.lit(ttl)


def warm(store: DataFrame, now, size: int = SIZE, ttl: float | None = TTL) -> DataFrame:
    """The newest `size` entries by last access, of these the ones that haven't expired: the limit comes first."""
    return store.orderBy(F.desc_nulls_last("last_accessed"), "entry_id").limit(size).where(~F.coalesce(expired(F.col("created_at"), now, ttl), F.lit(True)))


def victims(store: DataFrame, size: int) -> DataFrame:
    """Entries to evict down to `size`: the fewest hits first, then the longest unused.

    Entries are counted by hits and hour of last use; only the group on the edge is ordered row
    by row, so no task gets more than the entries of one group, whatever goes.
    """
    hour = F.floor(F.col("last_accessed") / 3600)
    keys = [F.coalesce("hits", F.lit(-1)).alias("_h"), F.coalesce(hour, F.lit(-(1 << 60))).alias("_t")]
    by = ["_h", "_t"]
    g = store.groupBy(*keys).agg(F.count("*").alias("_n"))
    per = g.groupBy("_h").agg(F.sum("_n").alias("_s"))
    w = Window.orderBy("_h")  # one row a number of hits
    per = per.select("_h", (F.sum("_s").over(w) - F.col("_s")).alias("_under"), F.sum("_s").over(Window.partitionBy()).alias("_all"))
    g = g.withColumn("_before", F.sum("_n").over(Window.partitionBy("_h").orderBy("_t")) - F.col("_n")).join(per, "_h")
    g = g.select("_h", "_t", "_n", (F.col("_all") - size - F.col("_under") - F.col("_before")).alias("_over")).where("_over > 0")
    x = store.withColumns({"_h": keys[0], "_t": keys[1]}).join(g, by)
    whole = x.where("_over >= _n")
    edge = x.where("_over < _n").withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(F.asc_nulls_first("last_accessed"), "entry_id"))).where("_i <= _over")
    return whole.select(*store.columns).unionByName(edge.select(*store.columns))


def storable(entries: DataFrame) -> DataFrame:
    """Entries with a query and an answer of at least LEAST_ANSWER characters."""
    return entries.where((F.coalesce(T.squeeze(F.col("query")), F.lit("")) != "") & (F.length(T.squeeze(F.col("answer"))) >= LEAST_ANSWER))


def put(store: DataFrame, entries: DataFrame) -> DataFrame:
    """The store with new entries merged in by normalized query; the entry created last wins."""
    both = store.unionByName(storable(entries), allowMissingColumns=True)
    cols = both.columns
    g = both.groupBy("normalized_query").agg(F.max_by(F.struct(*cols), F.struct(F.coalesce("created_at", F.lit(0.0)), "entry_id")).alias("x"))
    return g.select("x.*").select(*cols)


def without_answers(store: DataFrame, answers: DataFrame) -> DataFrame:
    """The store without entries whose trimmed answer was rejected."""
    a = answers.select(F.trim("answer").alias("_a")).distinct()
    return store.withColumn("_a", F.trim("answer")).join(a, "_a", "left_anti").drop("_a")


def fingerprint(df: DataFrame, *cols: str) -> DataFrame:
    """One row: the number of rows and a checksum of their contents; edits that keep the number show."""
    return df.agg(F.count("*").alias("n"), F.expr("sum(cast(h as decimal(38,0)))").alias("checksum")) if "h" in df.columns else fingerprint(df.select(F.xxhash64(*(cols or df.columns)).alias("h")))


def lookup(asked: DataFrame, store: DataFrame, threshold: float = THRESHOLD, now: Column | float | None = None, ttl: float | None = TTL) -> DataFrame:
    """(query_id, entry_id, match) of asked (query_id, query, vector): exact, else canonical, else semantic.

    Exact and canonical are equi-joins to the store reduced to one entry a key (the last created).
    A semantic match needs a cosine of at least the threshold and the same set of content words,
    numbers among them: so candidates meet by the hash of that set, never all with all. Of the
    entries of one set only distinct vectors are compared, and sets of many vectors are split.

    Entries older than ttl at `now` serve no tier (without `now` none is old; one without a time
    of creation is). A null or zero vector, or one of another length, has no semantic match.
    """
    if now is not None and ttl:
        store = store.where(~F.coalesce(expired(F.col("created_at"), now, ttl), F.lit(True)))
    latest = lambda df, key: df.groupBy(key).agg(F.max_by("entry_id", F.struct("created_at", "entry_id")).alias("entry_id"))
    s = store.withColumn("norm", normalized(F.col("query"))).withColumn("canon", T.canonical(F.col("query"))).where("norm <> ''")
    q = asked.withColumn("norm", normalized(F.col("query"))).withColumn("canon", T.canonical(F.col("query")))
    exact = q.join(latest(s, "norm"), "norm").select("query_id", "entry_id", F.lit("exact").alias("match"))
    rest = q.join(exact.select("query_id"), "query_id", "left_anti")
    canon = rest.where("canon <> ''").join(latest(s.where("canon <> ''"), "canon"), "canon").select("query_id", "entry_id", F.lit("canonical").alias("match"))
    rest = rest.join(canon.select("query_id"), "query_id", "left_anti")
    words = lambda c: F.array_join(F.array_sort(F.array_distinct(T.content_words(c))), " ")
    some = lambda c: F.exists(c, lambda x: x != 0)
    near = rest.withColumn("bag", words(F.col("query"))).where("bag <> ''").where(some("vector")).select("query_id", "bag", F.col("vector").alias("qv"))
    held = s.withColumn("bag", words(F.col("query"))).where("bag <> ''").where(some("vector")).groupBy("bag", F.col("vector").alias("sv")).agg(F.min("entry_id").alias("entry_id"))
    held = held.withColumn("part", F.pmod(F.xxhash64("sv"), F.lit(PARTS)).cast("int"))  # a set that many entries have is met in parts
    near = near.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).join(held, ["bag", "part"])
    near = near.withColumn("cosine", cosine(F.col("qv"), F.col("sv"))).where(F.col("cosine") >= threshold)
    near = near.groupBy("query_id").agg(F.max_by("entry_id", F.struct("cosine", -F.col("entry_id"))).alias("entry_id")).withColumn("match", F.lit("semantic"))
    return exact.unionByName(canon).unionByName(near)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 for null, other lengths, zero or non-finite vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    c = dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (dot(a, a) > 0) & (dot(b, b) > 0) & ~F.isnan(c), c).otherwise(0.0)


def unit(v: Column) -> Column:
    """A vector of length 1; null for null, zero and non-finite ones."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when((n > 0) & ~F.isnan(n) & (n < float("inf")), F.transform(v, lambda x: (x / n).cast("float")))


def nearest_other(store: DataFrame, dim: int = 64, block: int = 65_536, part: int = 8_192) -> DataFrame:
    """(entry_id, other_id, cosine): the other entry of highest cosine to each entry, exactly; of those within 1e-6 the smallest id.

    All rows meet all rows: they go to the tasks in blocks of about `block` vectors as a matrix, and a row answers
    each block with one other. Vectors that aren't `dim` finite numbers, or are all zero, take no part.
    """
    import numpy as np
    import pyarrow as pa

    from vellum.session import checkpointed

    spark = store.sparkSession
    v = F.col("vector").cast("array<float>")
    fine = (F.size(v) == dim) & F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = store.where("entry_id is not null").select(F.col("entry_id").cast("bigint").alias("entry_id"), v.alias("vector")).where(fine)
    n = rows.count()
    rows = checkpointed(rows.repartition(max(spark.sparkContext.defaultParallelism, -(-n // part)), "entry_id").dropDuplicates(["entry_id"]))

    def units(b) -> tuple:
        order = np.argsort(ids := b["entry_id"].to_numpy())
        got = b["vector"].combine_chunks() if isinstance(b, pa.Table) else b["vector"]
        x = got.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)[order]
        x /= np.abs(x).max(1, keepdims=True, initial=1e-300)  # squares neither overflow nor vanish
        return ids[order], (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)

    def meet(held: tuple) -> DataFrame:
        sent = spark.sparkContext.broadcast(held)

        def scan(batches):
            ids, x = sent.value
            step = max(1, 8_000_000 // len(ids))
            for b in batches:
                if not b.num_rows:
                    continue
                own, q = units(b)
                for a in range(0, len(q), step):
                    me, s = own[a : a + step], q[a : a + step] @ x.T
                    at = np.minimum(np.searchsorted(ids, me), len(ids) - 1)
                    same = np.flatnonzero(ids[at] == me)
                    s[same, at[same]] = -2
                    best = s.max(1)
                    ok = best > -2
                    j = (s >= (best - 1e-6)[:, None]).argmax(1)
                    c = np.round(np.einsum("ij,ij->i", q[a : a + step].astype(np.float64), x[j].astype(np.float64)), 6)
                    yield pa.RecordBatch.from_arrays([pa.array(me[ok]), pa.array(ids[j][ok]), pa.array(c[ok])], ["entry_id", "other_id", "cosine"])

        return rows.mapInArrow(scan, "entry_id bigint, other_id bigint, cosine double")

    blocks = max(1, -(-n // block))
    out = None
    for k in range(blocks):
        held = rows.where(F.pmod(F.xxhash64("entry_id", F.lit(5)), F.lit(blocks)) == k).toArrow()
        if held.num_rows:
            got = meet(units(held))
            out = got if out is None else out.unionByName(got)
    if out is None:
        return rows.select("entry_id", F.col("entry_id").alias("other_id"), F.lit(0.0).alias("cosine")).limit(0)
    best = F.max(F.struct("cosine", (-F.col("other_id")).alias("id")))
    return out.groupBy("entry_id").agg(best.alias("x")).select("entry_id", (-F.col("x.id")).alias("other_id"), F.col("x.cosine").alias("cosine"))


def sweep(pairs: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, kind, hits, n) of pairs (kind, cosine, same_words): how many would hit by cosine alone and with equal words. One pass."""
    per = F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), (F.col("cosine") >= t).alias("hit")) for t in thresholds))).alias("x")
    p = pairs.select("kind", "same_words", per).select("kind", "same_words", "x.*")
    return p.groupBy("threshold", "kind").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"), F.count_if(F.col("hit") & F.col("same_words")).alias("guarded_hits"))


def keep_newest(files: DataFrame, most: int) -> DataFrame:
    """Files (name, size, changed) kept when the oldest are evicted until the sum of sizes is at most `most`.

    Sizes are summed by day first, so only the day on the edge is ordered row by row.
    """
    day = F.to_date("changed")
    d = files.groupBy(day.alias("day")).agg(F.sum("size").alias("s"))
    w = Window.orderBy(F.desc("day"))  # one row a day
    d = d.withColumn("before", F.sum("s").over(w) - F.col("s"))
    x = files.withColumn("day", day).join(d, "day")
    run = F.sum("size").over(Window.partitionBy("day").orderBy(F.desc("changed"), "name"))
    return x.withColumn("run", F.col("before") + run).where(F.col("run") <= most).select("name", "size", "changed")


def touched(store: DataFrame, served: DataFrame) -> DataFrame:
    """The store after it served (entry_id, at): hits grow by the number of times, last_accessed is the latest; counted before the join, so a hot entry costs one row a task."""
    g = served.where("entry_id is not null").groupBy("entry_id").agg(F.count("*").alias("_n"), F.max("at").alias("_at"))
    j = store.join(g, "entry_id", "left").withColumns({"hits": F.coalesce("hits", F.lit(0)) + F.coalesce("_n", F.lit(0)), "last_accessed": F.greatest("last_accessed", "_at")})
    return j.select(*store.columns)


def without(store: DataFrame, gone: DataFrame, key: str = "entry_id") -> DataFrame:
    """The store without the entries named."""
    return store.join(gone.select(key).distinct(), key, "left_anti")


def put_bounded(store: DataFrame, entries: DataFrame, size: int) -> DataFrame:
    """put(), then the least used are evicted until at most `size` entries are left."""
    from vellum.session import checkpointed

    merged = checkpointed(put(store, entries))
    return without(merged, victims(merged, size))


def canonical_index(store: DataFrame) -> DataFrame:
    """(canonical, entry_id): of the entries with one canonical key the last created."""
    s = store.withColumn("canonical", T.canonical(F.col("query"))).where("canonical <> ''")
    return s.groupBy("canonical").agg(F.max_by("entry_id", F.struct("created_at", "entry_id")).alias("entry_id"))


def matrix(store: DataFrame) -> DataFrame:
    """(entry_id, vector): unit vectors of the dimension that the first entry with a usable vector has; the others are left out."""
    u = store.select("entry_id", unit(F.col("vector")).alias("vector")).where("vector is not null and size(vector) > 0")
    return u.where(F.size("vector") == u.agg(F.min_by(F.size("vector"), "entry_id").alias("d")).scalar())


def with_meta(meta: DataFrame, changes: DataFrame) -> DataFrame:
    """Pairs (key, value) with changes (key, value) put over them; a null value deletes the key, of several changes of one key the largest value stays."""
    c = changes.groupBy("key").agg(F.max("value").alias("_new"))
    j = meta.select("key", "value").join(c.withColumn("_set", F.lit(True)), "key", "full")
    return j.select("key", F.when(F.col("_set"), F.col("_new")).otherwise(F.col("value")).alias("value")).where("value is not null")


def int8(v: Column) -> Column:
    """struct of scale and values of a vector as 8-bit integers, the largest component at 127; null for null, zero and non-finite ones."""
    big = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    ok = (big > 0) & ~F.isnan(big) & (big < float("inf"))
    return F.when(ok, F.struct((big / 127).alias("scale"), F.transform(v, lambda x: F.round(x.cast("double") * 127 / big).cast("tinyint")).alias("values")))


def current(store: DataFrame, before: str | None, now: str | None) -> DataFrame:
    """The store while what it was made from has the fingerprint it had; nothing of it once that changed. Without an earlier fingerprint it stays."""
    return store if before is None or before == now else store.limit(0)
