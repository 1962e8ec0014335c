"""Ranking: lexical, sparse and dense scores, their fusion, re-ranking and roll-up.

Queries are a DataFrame (query_id, query), documents (doc_id, text). Scores are rounded to six
decimals before ranks are given, and ties go to the smaller id, so results don't depend on the
order of additions. Nothing is broadcast by hint: Spark picks by size.

Null texts and queries have no words and match nothing; repeated query words count repeatedly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.session import checkpointed, estimated_bytes, small, spread

K1, B = 1.5, 0.75
#: Bytes of queries up to which their words go to every task.
SMALL = 1 << 20
#: Words of the queries that are sent together, and cells of a matrix of scores.
TERMS, CELLS = 200_000, 4_000_000
#: Queries above which pipeline() takes them through the points block by block.
MANY = 1024


def ranked(scores: DataFrame, k: int, score: str = "score", by: str = "query_id", key: str = "doc_id") -> DataFrame:
    """The k best rows of each query with their rank from 1."""
    w = Window.partitionBy(by).orderBy(F.desc(score), key)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token), one row per word."""
    return df.select(key, F.explode(T.words(F.col(text))).alias("token"))


def wanted(queries: DataFrame) -> DataFrame:
    """(query_id, token, times) of the queries' words."""
    return tokens(queries, "query_id", "query").groupBy("query_id", "token").agg(F.count("*").alias("times"))


def postings(docs: DataFrame, terms: DataFrame | None) -> DataFrame:
    """(doc_id, token, len, tf) for the words in terms (token), all words without terms; other words never leave the scan's stage.

    Each document also has a row for the empty word, with its number of words: so the size of the
    corpus comes out of the same pass. Rows are partitioned by document, so what is summed over
    the words of a document needs no further shuffle.
    """
    d = spread(docs.select("doc_id", "text"), "doc_id").select("doc_id", T.words(F.col("text")).alias("w"))
    rows = d.select("doc_id", F.size("w").alias("len"), F.explode(F.concat(F.array(F.lit("")), "w")).alias("token"))
    if terms is not None:
        t = terms.select("token").distinct()
        rows = rows.join(small(t.unionByName(t.sparkSession.range(1).select(F.lit("").alias("token")))), "token", "left_semi")
    return rows.repartition("doc_id").groupBy("doc_id", "token", "len").agg(F.count("*").alias("tf"))


def vocabulary(p: DataFrame) -> DataFrame:
    """(token, df, n, avgdl) of written postings: in how many documents each word is, and the number of documents and their mean words."""
    size = p.where("token = ''").agg(F.sum("tf").alias("n"), F.sum(F.col("tf") * F.col("len")).alias("words")).first()  # one row
    n = size.n or 0
    return p.where("token <> ''").groupBy("token").agg(F.count("*").alias("df")).withColumns({"n": F.lit(n).cast("bigint"), "avgdl": F.lit((size.words or 0) / n if n else None).cast("double")})


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: n documents and their mean number of words."""
    return docs.agg(F.count("*").alias("n"), F.avg(F.size(T.words(F.col("text")))).alias("avgdl"))


def matches(docs: DataFrame, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, doc_id, bm25, sparse, overlap) of all documents that share a word with a query: all lexical scores by one pass over the corpus and one join.

    bm25 adds up over the query's words, repeated ones as often as they occur; sparse is the dot
    product of tf-idf weights; overlap counts distinct words that both have. The postings of the
    queries' words are written once, as both the frequencies of words and the scores need them.
    The queries' words go to the documents where they are small; then only the best rows of each
    task are shuffled by ranked().
    """
    q = wanted(queries)
    p = checkpointed(postings(docs, q))
    v = vocabulary(p)
    q = q.join(v, "token") if estimated_bytes(queries) > SMALL else F.broadcast(q.join(v, "token"))
    df, n, tf = F.col("df"), F.col("n"), F.col("tf")
    idf, plain = F.log((n - df + 0.5) / (df + 0.5) + 1), F.log(n / df) + 1
    q = q.select("query_id", "token", (F.col("times") * idf * (k1 + 1)).alias("x"), (F.col("times") * plain * plain).alias("y"), "avgdl")
    part = F.col("x") * tf / (tf + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
    s = p.where("token <> ''").join(q, "token").groupBy("query_id", "doc_id")
    return s.agg(F.round(F.sum(part), 6).alias("bm25"), F.round(F.sum(F.col("y") * tf), 6).alias("sparse"), F.count("*").cast("double").alias("overlap"))


def bm25(docs: DataFrame, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, doc_id, score) of all documents that share a word with a query."""
    return matches(docs, queries, k1, b).select("query_id", "doc_id", F.col("bm25").alias("score"))


def overlap(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): distinct words that both have."""
    return matches(docs, queries).select("query_id", "doc_id", F.col("overlap").alias("score"))


def sparse(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): dot product of tf-idf weights over shared words."""
    return matches(docs, queries).select("query_id", "doc_id", F.col("sparse").alias("score"))


def lists_of(docs: DataFrame, queries: DataFrame, methods: list[str], k: int, k1: float = K1, b: float = B) -> DataFrame:
    """(method, query_id, doc_id, score, rank): the k best documents by bm25, sparse or overlap, as matches() scores them, without making all pairs.

    Queries go to the tasks in blocks of at most TERMS words. Words of documents that no query of
    the block has stay in the scan's task; the others are written once, as the frequencies of
    words have to be known before any score. A task scores its documents word by word in
    matrices of bounded size and answers with its own k best of each query and method, so what is
    shuffled is k rows a task, method and query, however frequent a word is. A document is a row;
    rows of one query id are one query.
    """
    d = spread(docs.select("doc_id", "text"), "doc_id").select("doc_id", T.words(F.col("text")).alias("w"))
    q = queries.select("query_id", T.words(F.col("query")).alias("w")).where(F.size("w") > 0).groupBy("query_id").agg(F.flatten(F.collect_list("w")).alias("w"))
    out, held, n = None, [], 0
    for r in q.toLocalIterator():
        held.append((r.query_id, r.w))
        n += len(r.w)
        if n >= TERMS:
            got = _scored(d, held, q.schema["query_id"].dataType, methods, k, k1, b)
            out, held, n = got if out is None else out.unionByName(got), [], 0
    if held or out is None:
        got = _scored(d, held, q.schema["query_id"].dataType, methods, k, k1, b)
        out = got if out is None else out.unionByName(got)
    w = Window.partitionBy("method", "query_id").orderBy(F.desc("score"), "doc_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _scored(d: DataFrame, asked: list, kind, methods: list[str], k: int, k1: float, b: float) -> DataFrame:
    """The k best of each task for one block of queries, given as (id, words)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql.pandas.types import to_arrow_type

    spark, doc = d.sparkSession, d.schema["doc_id"].dataType
    types = to_arrow_type(kind), to_arrow_type(doc)
    owner, word = np.repeat(np.arange(len(asked)), [len(w) for _, w in asked]), [x for _, w in asked for x in w]
    vocabulary = pa.array(sorted(set(word)), pa.string())
    term = pc.index_in(pa.array(word, pa.string()), value_set=vocabulary).to_numpy(zero_copy_only=False)
    pairs, times = np.unique(np.stack([term, owner]).astype(np.int64), axis=1, return_counts=True)  # by word, then query
    names = spark.sparkContext.broadcast(vocabulary)

    def known(batches):
        words = names.value
        for x in batches:
            lists = x.column(1)
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = pc.index_in(lists.flatten(), value_set=words).fill_null(-1).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(size)), size)
            row, ids = row[ids >= 0], ids[ids >= 0].astype(np.int64)
            code, tf = np.unique(row * max(1, len(words)) + ids, return_counts=True)
            row, ids = code // max(1, len(words)), code % max(1, len(words))
            ends = pa.array(np.searchsorted(row, np.arange(len(size) + 1)), pa.int32())
            parts = [pa.ListArray.from_arrays(ends, pa.array(v.astype(np.int32))) for v in (ids, tf)]
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(size.astype(np.int32)), *parts], ["doc_id", "len", "ids", "tf"])

    p = checkpointed(d.mapInArrow(known, f"doc_id {doc.simpleString()}, len int, ids array<int>, tf array<int>"))
    size = p.agg(F.count("*").alias("n"), F.sum("len").alias("words")).first()
    df = np.ones(len(vocabulary))
    for r in p.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("df")).toLocalIterator():  # at most the block's words
        df[r.id] = r.df
    n, mean = max(1, size.n or 0), max((size.words or 0) / max(1, size.n or 0), 1e-9)
    idf, plain = np.log((n - df + 0.5) / (df + 0.5) + 1), np.log(n / df) + 1
    weight = {"bm25": times * idf[pairs[0]] * (k1 + 1), "sparse": times * plain[pairs[0]] ** 2, "overlap": np.ones(len(times))}
    sent = spark.sparkContext.broadcast((pa.array([i for i, _ in asked], types[0]), np.searchsorted(pairs[0], np.arange(len(vocabulary) + 1)), pairs[1], {m: weight[m] for m in methods}))

    def score(batches):
        queries, edge, who, weight = sent.value
        step = max(1, CELLS // max(1, len(queries)))
        for x in batches:
            for a in range(0, x.num_rows, step):
                part = x.slice(a, step)
                size = part.column(2).value_lengths().to_numpy(zero_copy_only=False)
                ids, tf = part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy().astype(float)
                length = part.column(1).to_numpy()
                row = np.repeat(np.arange(len(size)), size)
                value = {"bm25": tf / (tf + k1 * (1 - b + b * length[row] / mean)), "sparse": tf, "overlap": np.ones(len(tf))}
                by = np.argsort(ids, kind="stable")
                cut = np.r_[np.flatnonzero(np.r_[True, np.diff(ids[by]) != 0]), len(by)] if len(by) else np.zeros(1, int)
                groups = [(by[s:e], slice(edge[ids[by[s]]], edge[ids[by[s]] + 1])) for s, e in zip(cut, cut[1:])]
                for m, w in weight.items():
                    total = np.zeros((len(queries), len(size)))
                    for at, span in groups:
                        total[who[span, None], row[at]] += w[span, None] * value[m][at]
                    yield _best(total, queries, part.column(0), k, m)

    def _best(total, queries, docs, k, method):
        few = min(k, total.shape[1])
        least = np.partition(total, total.shape[1] - few, 1)[:, total.shape[1] - few]
        r, c = np.nonzero((total >= least[:, None] - 2e-6) & (total > 0))  # rounding may make others equal to the last
        v = np.round(total[r, c], 6)
        order = np.lexsort((pc.rank(docs, "ascending").to_numpy()[c], -v, r))
        r, c, v = r[order], c[order], v[order]
        keep = np.flatnonzero(np.arange(len(r)) - np.searchsorted(r, r) < few)
        return pa.RecordBatch.from_arrays([pa.array([method] * len(keep), pa.string()), queries.take(pa.array(r[keep])), docs.take(pa.array(c[keep])), pa.array(v[keep])], ["method", "query_id", "doc_id", "score"])

    return p.where(F.size("ids") > 0).mapInArrow(score, f"method string, query_id {kind.simpleString()}, doc_id {doc.simpleString()}, score double")


def with_overlap(near: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """Candidates (query_id, doc_id, …) with the number of distinct words that both have; few a query, so only their texts are read again."""
    w = lambda c: F.array_distinct(T.words(F.col(c)))
    j = near.join(docs.select("doc_id", w("text").alias("_d")), "doc_id").join(queries.select("query_id", w("query").alias("_q")), "query_id")
    return j.select(*near.columns, F.size(F.array_intersect("_d", "_q")).cast("double").alias("overlap"))


def rrf(lists: DataFrame, k: float = 60, weights: dict[str, float] | None = None) -> DataFrame:
    """Fused (query_id, doc_id, score) of ranked lists (method, query_id, doc_id, rank from 1): the sum of weight / (k + rank)."""
    w: Column = F.lit(1.0)
    for m, x in (weights or {}).items():
        w = F.when(F.col("method") == m, F.lit(float(x))).otherwise(w)
    return lists.groupBy("query_id", "doc_id").agg(F.round(F.sum(w / (k + F.col("rank"))), 9).alias("score"))


def rrf_grid(lists: DataFrame, grid: list[tuple[float, dict[str, float]]], k: int) -> DataFrame:
    """(k, weights, query_id, doc_id, score, rank): the k best of rrf() for every constant and weights of the grid, by one pass over the lists."""
    cells = []
    for c, weights in grid:
        w: Column = F.lit(1.0)
        for m, x in weights.items():
            w = F.when(F.col("method") == m, F.lit(float(x))).otherwise(w)
        named = F.create_map(*(v for m, x in weights.items() for v in (F.lit(m), F.lit(float(x))))) if weights else F.create_map().cast("map<string,double>")
        cells.append(F.struct(F.lit(c).alias("k"), named.alias("weights"), (w / (c + F.col("rank"))).alias("part")))
    cell = F.posexplode(F.array(*cells)).alias("cell", "x")
    g = lists.select("method", "query_id", "doc_id", "rank", cell).groupBy("cell", "query_id", "doc_id").agg(F.any_value("x.k").alias("k"), F.any_value("x.weights").alias("weights"), F.round(F.sum("x.part"), 9).alias("score"))
    w = Window.partitionBy("cell", "query_id").orderBy(F.desc("score"), "doc_id")
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("k", "weights", "query_id", "doc_id", "score", "rank")


def score_fusion(lists: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Fused (query_id, doc_id, score): weighted sum of scores, each list scaled to 0..1; a constant list counts 1."""
    g = lists.groupBy("method", "query_id").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    s = F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0)
    w: Column = F.lit(0.0)
    for m, x in weights.items():
        w = F.when(F.col("method") == m, F.lit(float(x))).otherwise(w)
    return lists.join(g, ["method", "query_id"]).groupBy("query_id", "doc_id").agg(F.round(F.sum(w * s), 6).alias("score"))


def rerank_lexical(candidates: DataFrame, queries: DataFrame, k: int = 4, by: list[str] | None = None) -> DataFrame:
    """Candidates (by, query_id, doc_id, rank, overlap) anew by the share of the query's distinct words in the document plus 0.1 / rank, at most 1."""
    q = queries.select("query_id", F.size(F.array_distinct(T.words(F.col("query")))).alias("n"))
    s = F.least(F.lit(1.0), F.col("overlap") / F.greatest(F.col("n"), F.lit(1)) + 0.1 / F.col("rank"))
    c = candidates.join(q, "query_id").select(*(by or []), "query_id", "doc_id", F.col("rank").alias("before"), F.round(s, 6).alias("score"))
    w = Window.partitionBy(*(by or []), "query_id").orderBy(F.desc("score"), "before")
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def pass_through(candidates: DataFrame, k: int = 4) -> DataFrame:
    """Candidates when no re-ranker is on: the first k with score 1."""
    return candidates.where(F.col("rank") <= k).withColumn("score", F.lit(1.0))


def threshold(scored: DataFrame, least: float = 0.15, by: list[str] | None = None) -> DataFrame:
    """Rows of at least the score, but all rows of a query that would lose every one."""
    any_ = F.max(F.col("score") >= least).over(Window.partitionBy(*(by or []), "query_id"))
    return scored.withColumn("_any", any_).where(~F.col("_any") | (F.col("score") >= least)).drop("_any")


def dense(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank): the k highest cosines of queries (query_id, vector) among vectors (doc_id, vector).

    The queries go to the tasks in blocks of bounded size, as matrices; each batch of vectors
    answers with its own k best, so what is shuffled is k rows a batch and query.
    """
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    def block(rows: list) -> DataFrame:
        ids = [r.query_id for r in rows]
        q = np.array([r.vector for r in rows], np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        types = to_arrow_type(queries.schema["query_id"].dataType), to_arrow_type(vectors.schema["doc_id"].dataType)
        sent = vectors.sparkSession.sparkContext.broadcast((pa.array(ids, types[0]), q))

        def score(batches):
            ids, q = sent.value
            for b in batches:
                f = b.to_pandas()
                ok = f["vector"].map(lambda v: v is not None and len(v) == q.shape[1])
                f = f[ok.astype(bool)].sort_values("doc_id", kind="stable")
                if not len(f):
                    continue
                x = np.stack(f["vector"].to_numpy()).astype(np.float64)
                norm = np.linalg.norm(x, axis=1)
                fine = np.isfinite(norm) & (norm > 0)
                x, key = x[fine] / norm[fine][:, None], f["doc_id"].to_numpy()[fine]
                s = np.round(q @ x.T, 6)
                n = min(k, s.shape[1])
                if not n:
                    continue
                edge = np.partition(s, s.shape[1] - n, 1)[:, s.shape[1] - n]
                r, c = np.nonzero(s >= edge[:, None])  # the n best and what ties with the last
                order = np.lexsort((c, -s[r, c], r))
                r, c = r[order], c[order]
                keep = np.arange(len(r)) - np.searchsorted(r, r) < n
                r, c = r[keep], c[keep]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(r)), pa.array(key[c], types[1]), pa.array(s[r, c])], ["query_id", "doc_id", "score"])

        kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id {vectors.schema['doc_id'].dataType.simpleString()}, score double"
        return vectors.select("doc_id", "vector").mapInArrow(score, kinds)

    out, held = None, []
    for r in queries.where("vector is not null and size(vector) > 0").select("query_id", "vector").toLocalIterator():
        held.append(r)
        if len(held) == 4096:
            got, held = block(held), []
            out = got if out is None else out.unionByName(got)
    if held:
        got = block(held)
        out = got if out is None else out.unionByName(got)
    if out is None:
        return vectors.select(F.col("doc_id").alias("query_id"), "doc_id", F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
    return ranked(out, k)


def is_record(c: Column) -> Column:
    """Whether the first line of a chunk names a numbered record under a heading."""
    return F.substring_index(c, "\n", 1).rlike(r" > \d+\. .*$")


def rollup(hits: DataFrame, chunks: DataFrame, k: int = 4, least: int = 3, most: int = 2) -> DataFrame:
    """Hits (query_id, chunk_id, rank) with summaries put in.

    Where `least` hits of a query are numbered records of one document (the first such document
    on a tie), up to `most` of that document's chunks that are no records, the longest first,
    follow the best hit; then come the other hits, k in all. All chunks of the document are read.
    """
    c = chunks.select("chunk_id", "doc_id", is_record(F.col("content")).alias("record"), F.length("content").alias("size"))
    h = hits.join(c, "chunk_id")
    per = h.where("record").groupBy("query_id", "doc_id").agg(F.count("*").alias("n"), F.min("rank").alias("first")).where(F.col("n") >= least)
    doc = per.groupBy("query_id").agg(F.max_by("doc_id", F.struct("n", -F.col("first"))).alias("doc_id"))
    s = doc.join(c.where("not record"), "doc_id").join(hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    s = s.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("size"), "chunk_id"))).where(F.col("n") <= most)
    both = hits.select("query_id", "chunk_id", F.when(F.col("rank") == 1, 0.0).otherwise(2.0 + F.col("rank")).alias("place")).unionByName(s.select("query_id", "chunk_id", (1.0 + F.col("n") / 10).alias("place")))
    w = Window.partitionBy("query_id").orderBy("place", "chunk_id")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "chunk_id", "rank")


def metrics(ranked_lists: DataFrame, truth: DataFrame, k: int = 4, deep: int = 10, by: list[str] | None = None) -> DataFrame:
    """hit@k, mrr@k, hit@2k, recall@k, precision@k and mrr@deep of ranked lists (query_id, doc_id, rank) against truth (query_id, doc_id).

    Queries without truth are left out; queries without any hit count 0. A document counts once.
    """
    by = by or []
    t = truth.distinct()
    size = t.groupBy("query_id").agg(F.count("*").alias("size"))
    r = ranked_lists.join(t, ["query_id", "doc_id"], "left_semi").groupBy(*by, "query_id").agg(F.min("rank").alias("first"), F.count_distinct(F.when(F.col("rank") <= k, F.col("doc_id"))).alias("got"))
    if by:
        size = ranked_lists.select(*by, "query_id").distinct().join(size, "query_id")
    s = size.join(r, [*by, "query_id"], "left")
    mean = lambda c: F.round(F.avg(F.coalesce(c, F.lit(0.0))), 6)
    first = F.col("first")
    return s.groupBy(*by).agg(
        F.count("*").alias("queries"),
        mean((first <= k).cast("double")).alias("hit_k"),
        mean(F.when(first <= k, 1.0 / first)).alias("mrr_k"),
        mean((first <= 2 * k).cast("double")).alias("hit_2k"),
        mean(F.col("got") / F.col("size")).alias("recall_k"),
        mean(F.col("got") / F.lit(float(k))).alias("precision_k"),
        mean(F.when(first <= deep, 1.0 / first)).alias("mrr_deep"),
    )


def contexts(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, context, sources, has_table, articles): the labelled text blocks of each query's hits in order, its distinct sources, and the articles that may be cited."""
    c = hits.join(chunks, "chunk_id")
    block = F.concat(F.lit("["), F.col("doc_name"), F.lit("]\n"), F.col("content"))
    g = c.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("l"),  # k rows
        F.array_sort(F.collect_set(F.when(T.is_source_name(F.col("doc_name")), F.col("doc_name")))).alias("sources"),
        F.coalesce(F.bool_or("is_table"), F.lit(False)).alias("has_table"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(T.articles(F.col("content")))))).alias("articles"),
    )
    return g.select("query_id", F.array_join(F.transform("l", lambda x: x["b"]), "\n\n").alias("context"), "sources", "has_table", "articles")


def variants(lists: DataFrame, dense_name: str = "dense", sparse_name: str = "sparse", k: int = 8) -> DataFrame:
    """(variant, query_id, doc_id, score, rank) of ranked lists (method, query_id, doc_id, score, rank): each list alone, rank fusion with constants 2, 10 and 60 and with sparse weights 0.5 to 3, score fusion with dense shares 0.3 to 0.7."""
    own = lists.where(F.col("method").isin(dense_name, sparse_name))
    parts = {m: own.where(F.col("method") == m).select("query_id", "doc_id", "score") for m in (dense_name, sparse_name)}
    parts |= {f"rrf k={c}": rrf(own, c) for c in (2, 10, 60)}
    parts |= {f"rrf k=60 sparse={w}": rrf(own, 60, {sparse_name: w}) for w in (0.5, 1.5, 2.0, 3.0)}
    parts |= {f"score dense={a}": score_fusion(own, {dense_name: a, sparse_name: 1 - a}) for a in (0.3, 0.5, 0.7)}
    out = None
    for name, p in parts.items():
        one = ranked(p, k).select(F.lit(name).alias("variant"), "query_id", "doc_id", "score", "rank")
        out = one if out is None else out.unionByName(one)
    return out


def usable(v: Column, dim: int) -> Column:
    """Whether a vector has dim finite numbers, not all zero."""
    return F.coalesce((F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


def pipeline(points: DataFrame, queries: DataFrame, constants: tuple[float, ...] = (60,), depth: int = 100, keep: int = 8, k: int = 4, least: float = 0.15, dim: int = 64) -> DataFrame:
    """(constant, query_id, doc_id, rank, score): points (doc_id, text, vector) for queries (query_id, query, vector).

    Dense and sparse lists of `depth` are fused by rank, once for each constant; the best `keep`
    are re-ranked by shared words and the best k stay, of these the ones of at least `least`
    unless none is. A query or point without a usable vector takes part in the sparse list only,
    one without words in the dense list only; a query with neither has no rows. Few queries go to
    the points; many are taken through them block by block, as lists of every task for every query
    would outgrow the tables.
    """
    n, ids = queries.agg(F.count("*"), F.count_distinct("query_id")).first()
    if n > MANY and n == ids:
        from vellum.operators.fused import fused

        own = lambda df, key, text: spread(df.select(key, text, "vector"), key).select(key, T.words(F.col(text)).alias("w"), F.when(usable(F.col("vector"), dim), F.col("vector")).alias("vector"))
        near = fused(own(points, "doc_id", "text"), own(queries, "query_id", "query"), constants, depth, keep, dim)
        near = near.withColumn("constant", F.col("constant").cast("int" if all(isinstance(c, int) for c in constants) else "double"))
    else:
        a = dense(points.where(usable(F.col("vector"), dim)).select("doc_id", "vector"), queries.where(usable(F.col("vector"), dim)).select("query_id", "vector"), depth)
        b = lists_of(points, queries, ["sparse"], depth).select("query_id", "doc_id", "rank")
        both = a.select(F.lit("dense").alias("method"), "query_id", "doc_id", "rank").unionByName(b.select(F.lit("sparse").alias("method"), "*"))
        near = rrf_grid(both, [(c, {}) for c in constants], keep).select(F.col("k").alias("constant"), "query_id", "doc_id", "rank")
    near = with_overlap(near, points, queries)
    return threshold(rerank_lexical(near, queries, k, ["constant"]), least, ["constant"]).select("constant", "query_id", "doc_id", "rank", "score")


def answer_context(chunks: DataFrame, queries: DataFrame, model=None, k: int = 4, **options) -> DataFrame:
    """(query_id, context, sources, has_table, articles) for queries (query_id, query) over chunks (chunk_id, doc_id, doc_name, content, is_table): both are embedded by `model`, ranked by pipeline(), rolled up where many hits are records of one document, and put together."""
    from vellum.operators import models

    p = models.embed(chunks.where(T.squeeze(F.col("content")) != "").select(F.col("chunk_id").alias("doc_id"), F.col("content").alias("text")), "text", model).withColumnRenamed("dense", "vector")
    q = models.embed(queries.where(T.squeeze(F.col("query")) != ""), "query", model).withColumnRenamed("dense", "vector")
    hits = pipeline(p.select("doc_id", "text", "vector"), q.select("query_id", "query", "vector"), k=k, **options)
    rolled = rollup(hits.select("query_id", F.col("doc_id").alias("chunk_id"), "rank"), chunks.select("chunk_id", "doc_id", "content"), k)
    return contexts(rolled, chunks.select("chunk_id", "doc_name", "content", "is_table"))


def full_pipeline(docs: DataFrame, queries: DataFrame, dense_lists: DataFrame, k: int = 4, bonus: float = 0.05) -> DataFrame:
    """Queries with abbreviations written out, BM25 and dense lists fused by rank, the best 2k with a bonus for each distinct shared word, the best k."""
    full = queries.withColumn("query", T.expand(F.col("query")))
    a = lists_of(docs, full, ["bm25"], 100)
    fused = ranked(rrf(a.unionByName(dense_lists.select(*a.columns))), 2 * k).drop("rank")
    shared = with_overlap(fused.select("query_id", "doc_id"), docs, full).withColumnRenamed("overlap", "shared")
    s = fused.join(shared, ["query_id", "doc_id"], "left").withColumn("score", F.round(F.col("score") + bonus * F.coalesce("shared", F.lit(0.0)), 9)).drop("shared")
    return ranked(s, k)


def latent(docs: DataFrame, queries: DataFrame, k: int, dims: int = 128, features: int = 5000) -> DataFrame:
    """The k highest cosines in a latent space: tf-idf of words and pairs of words, reduced by singular values and scaled to length 1. The space is fitted on all documents; its matrix of features x dims is bounded by both."""
    from pyspark.ml.feature import IDF, CountVectorizer, NGram
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.linalg.distributed import RowMatrix

    split = lambda d, c: NGram(n=2, inputCol="w", outputCol="p").transform(d.withColumn("w", T.words(F.col(c)))).withColumn("t", F.concat("w", "p"))
    d = split(docs.where("text is not null"), "text")
    counts = CountVectorizer(inputCol="t", outputCol="tf", vocabSize=features).fit(d)
    idf = IDF(inputCol="tf", outputCol="v").fit(counts.transform(d))
    vec = lambda x: idf.transform(counts.transform(x))
    n = len(counts.vocabulary)
    rows = vec(d).select("v").rdd.map(lambda r: Vectors.sparse(n, r[0].indices.tolist(), r[0].values.tolist()))
    basis = RowMatrix(rows).computeSVD(min(dims, n - 1)).V.toArray()
    space = docs.sparkSession.sparkContext.broadcast(basis)

    @F.pandas_udf("array<double>")
    def project(i, v):
        import numpy as np
        import pandas as pd

        out = []
        for a, b in zip(i, v, strict=True):
            x = np.asarray(b, float) @ space.value[np.asarray(a, int)] if len(a) else np.zeros(space.value.shape[1])
            out.append((x / (np.linalg.norm(x) or 1.0)).tolist())
        return pd.Series(out)

    @F.udf("struct<i:array<int>,v:array<double>>")
    def parts(v):
        return v.indices.tolist(), v.values.tolist()

    place = lambda x: vec(x).withColumn("_s", parts("v")).withColumn("vector", project("_s.i", "_s.v"))
    q = place(split(queries.where("query is not null"), "query")).select("query_id", "vector")
    return dense(place(d).select("doc_id", "vector"), q, k)
