"""Queries of ranking. The queries are the questions and passages of eval_items, the corpus documents and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import retrieval as R
from vellum.plans.catalogue import query
from vellum.session import table


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def _questions(spark, d):
    return table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), F.col("question").alias("query"))


_W = "regexp_extract_all(lower(coalesce({}, '')), '[\\p{{L}}\\p{{N}}_]+')"
_BASE = f"""
with d as (select doc_id, {_W.format("text")} as w from documents),
p as (select doc_id, token, len, count(*) as tf from (select doc_id, len(w) as len, unnest(w) as token from d) group by all),
q as (select query_id, token, count(*) as times from (select item_id as query_id, unnest({_W.format("question")}) as token from eval_items) group by all),
s as (select count(*) as n, avg(len(w)) as avgdl from d),
df as (select token, count(*) as df from p group by token),
bm as (select query_id, doc_id, round(sum(times * ln(((select n from s) - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / (select avgdl from s)))), 6) as score
  from p join df using (token) join q using (token) group by all),
ov as (select query_id, doc_id, count(*)::double as score from p join q using (token) group by all),
sp as (select query_id, doc_id, round(sum(times * (ln((select n from s) / df) + 1) * tf * (ln((select n from s) / df) + 1)), 6) as score from p join df using (token) join q using (token) group by all)
"""
_RANK = "row_number() over (partition by query_id order by score desc, doc_id)"


@query(_BASE + f"select * from (select query_id, doc_id, score, {_RANK} as rank from bm) where rank <= 10")
def bm25_top10(spark, d):
    return R.lists_of(_docs(spark, d), _questions(spark, d), ["bm25"], 10).drop("method")


@query(_BASE + "select token, df, round(ln(((select n from s) - df + 0.5) / (df + 0.5) + 1), 6) as idf from df")
def corpus_terms(spark, d):
    """All words of the corpus with their weights, as an index holds them."""
    df, n = F.col("df"), F.col("n")
    return R.vocabulary(R.checkpointed(R.postings(_docs(spark, d), None))).select("token", "df", F.round(F.log((n - df + 0.5) / (df + 0.5) + 1), 6).alias("idf"))


@query(_BASE + "select n, round(avgdl, 6) as avgdl from s")
def corpus_size(spark, d):
    return R.corpus_stats(_docs(spark, d)).select("n", F.round("avgdl", 6).alias("avgdl"))


@query(_BASE + f"select * from (select query_id, doc_id, score, {_RANK} as rank from ov) where rank <= 10")
def overlap_top10(spark, d):
    return R.lists_of(_docs(spark, d), _questions(spark, d), ["overlap"], 10).drop("method")


@query(_BASE + f"select * from (select query_id, doc_id, score, {_RANK} as rank from sp) where rank <= 10")
def sparse_top10(spark, d):
    return R.lists_of(_docs(spark, d), _questions(spark, d), ["sparse"], 10).drop("method")


_LISTS = (
    _BASE
    + f""", lists as (select 'bm25' as method, * from (select query_id, doc_id, score, {_RANK} as rank from bm) where rank <= 100
  union all select 'overlap', * from (select query_id, doc_id, score, {_RANK} as rank from ov) where rank <= 100)
"""
)


def _lists(spark, d):
    return R.lists_of(_docs(spark, d), _questions(spark, d), ["bm25", "overlap"], 100)


@query(_LISTS + f", f as (select query_id, doc_id, round(sum(1.0::double / (60 + rank)), 9) as score from lists group by all) select * from (select query_id, doc_id, score, {_RANK} as rank from f) where rank <= 4")
def hybrid_top4(spark, d):
    """The flagship: lexical and overlap lists of 100, fused by rank, the best 4."""
    return R.ranked(R.rrf(_lists(spark, d)), 4)


def _variant(k, w):
    return f"select {k} as k, {w} as weight, query_id, doc_id, round(sum(case method when 'bm25' then {w}::double else 1.0::double end / ({k} + rank)), 9) as score from lists group by query_id, doc_id"


@query(_LISTS + ", f as (" + " union all ".join(_variant(k, w) for k in (2, 10, 60) for w in (1.0, 2.0)) + ") select * from (select k, weight, query_id, doc_id, score, row_number() over (partition by k, weight, query_id order by score desc, doc_id) as rank from f) where rank <= 4")
def rrf_variants(spark, d):
    return R.rrf_grid(_lists(spark, d), [(k, {"bm25": w}) for k in (2, 10, 60) for w in (1.0, 2.0)], 4).select("k", F.col("weights.bm25").alias("weight"), "query_id", "doc_id", "score", "rank")


@query(
    _LISTS
    + f""", g as (select method, query_id, min(score) as lo, max(score) as hi from lists group by all),
f as (select query_id, doc_id, round(sum(case method when 'bm25' then 0.7::double else 0.3::double end * case when hi > lo then (score - lo) / (hi - lo) else 1.0 end), 6) as score from lists join g using (method, query_id) group by all)
select * from (select query_id, doc_id, score, {_RANK} as rank from f) where rank <= 4"""
)
def score_fusion_top4(spark, d):
    return R.ranked(R.score_fusion(_lists(spark, d), {"bm25": 0.7, "overlap": 0.3}), 4)


_RERANK = (
    _LISTS
    + f""", c as (select query_id, doc_id, rank as before from lists where method = 'bm25' and rank <= 8),
r as (select query_id, doc_id, before, round(least(1.0, len(list_intersect(list_distinct({_W.format("question")}), list_distinct({_W.format("text")}))) / greatest(len(list_distinct({_W.format("question")})), 1) + 0.1::double / before), 6) as score
  from c join documents using (doc_id) join eval_items on item_id = query_id),
rr as (select * from (select *, row_number() over (partition by query_id order by score desc, before) as rank from r) where rank <= 4)
"""
)


def _reranked(spark, d):
    q = _questions(spark, d)
    near = R.lists_of(_docs(spark, d), q, ["bm25"], 8).select("query_id", "doc_id", "rank")
    return R.rerank_lexical(R.with_overlap(near, _docs(spark, d), q), q)


@query(_RERANK + "select query_id, doc_id, before, score, rank from rr")
def rerank_lexical(spark, d):
    return _reranked(spark, d)


@query(_RERANK + "select query_id, doc_id, score, rank from (select *, max(score >= 0.6) over (partition by query_id) as ok from rr) where not ok or score >= 0.6")
def relevance_threshold(spark, d):
    return R.threshold(_reranked(spark, d), 0.6).select("query_id", "doc_id", "score", "rank")


def _truth(docs, items):
    """(query_id, doc_id): which documents hold the passage of items (query_id, passage) word for word."""
    w = R.T.words(F.col("passage"))
    inner = F.slice(w, 2, F.greatest(F.size(w) - 2, F.lit(0)))  # whole words wherever the passage stands
    items = items.select("query_id", "passage").withColumn("token", F.array_max(F.transform(inner, lambda x: F.struct(F.length(x).alias("n"), x.alias("word"))))["word"])
    held = R.spread(docs, "doc_id").select("doc_id", F.explode(F.array_distinct(R.T.words(F.col("text")))).alias("token"))
    pairs = held.join(R.small(items.where("token is not null").select("query_id", "token")), "token").select("query_id", "doc_id")  # ids only, by one word
    truth = pairs.join(docs, "doc_id").join(items, "query_id").where(F.contains("text", F.col("passage"))).select("query_id", "doc_id")  # then the exact test
    short = docs.select("doc_id", "text").join(items.where("token is null"), F.contains("text", F.col("passage"))).select("query_id", "doc_id")  # passages without an inner word
    return truth.unionByName(short)


@query(
    _LISTS
    + """, top as (select method, query_id, doc_id, rank from lists where rank <= 10),
t as (select e.item_id as query_id, doc_id from documents join eval_items e on contains(text, e.passage)),
size as (select query_id, count(*) as size from t group by 1),
hit as (select method, query_id, min(rank) as first, count(distinct case when rank <= 4 then doc_id end) as got from top join t using (query_id, doc_id) group by all),
a as (select distinct method, query_id from top)
select method, count(*) as queries, round(avg(coalesce((first <= 4)::int, 0)), 6) as hit_k, round(avg(coalesce(case when first <= 4 then 1.0::double / first end, 0)), 6) as mrr_k,
 round(avg(coalesce((first <= 8)::int, 0)), 6) as hit_2k, round(avg(coalesce(got / size, 0)), 6) as recall_k, round(avg(coalesce(got / 4.0::double, 0)), 6) as precision_k, round(avg(coalesce(case when first <= 10 then 1.0::double / first end, 0)), 6) as mrr_deep
from a join size using (query_id) left join hit using (method, query_id) group by method"""
)
def retrieval_metrics(spark, d):
    """Two lists judged by which documents hold the item's passage word for word, found by the shared words first."""
    docs = _docs(spark, d)
    items = table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), "passage")
    top = _lists(spark, d).where("rank <= 10").select("method", "query_id", "doc_id", "rank")
    truth = _truth(docs, items)
    return R.metrics(top, truth, by=["method"])


_UNIT = "vector is not null and len(vector) = 64 and list_bool_and(list_transform(vector, lambda x: isfinite(x))) and list_max(list_transform(vector, lambda x: abs(x))) > 0"


@query(
    f"""with v as (select vec_id, label, embedding::double[64] as e from embeddings), c as (select a.vec_id as query_id, b.vec_id as doc_id, round(array_cosine_similarity(a.e, b.e), 6) as score from v a, v b where a.vec_id % 100 = 0)
select * from (select query_id, doc_id, score, {_RANK} as rank from c) where rank <= 5"""
)
def dense_top5(spark, d):
    """The queries are the vectors whose id is divisible by 100, against all vectors."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return R.dense(v, v.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "vector"), 5)


@query(
    f"""with v as (select vec_id, label, embedding::double[64] as e from embeddings), c as (select a.vec_id as query_id, a.label as la, b.label as lb, b.vec_id as doc_id, round(array_cosine_similarity(a.e, b.e), 6) as score from v a, v b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
t as (select * from (select *, {_RANK} as rank from c) where rank <= 4)
select la as label, count(distinct query_id) as queries, round(avg((la = lb)::int), 6) as precision_4 from t group by la"""
)
def dense_label_precision(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")
    top = R.dense(v, v.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "vector"), 5).where("query_id <> doc_id")
    top = R.ranked(top.drop("rank"), 4)
    l = v.select("doc_id", "label")  # noqa: E741
    j = top.join(l.withColumnRenamed("label", "lb"), "doc_id").join(l.select(F.col("doc_id").alias("query_id"), F.col("label")), "query_id")
    return j.groupBy("label").agg(F.count_distinct("query_id").alias("queries"), F.round(F.avg((F.col("label") == F.col("lb")).cast("int")), 6).alias("precision_4"))


@query(
    """with c as (select id as chunk_id, doc_id, content, regexp_matches(split_part(content, chr(10), 1), ' > [0-9]+[.] .*$') as record, length(content) as size from chunks),
h as (select doc_id as query_id, chunk_id, row_number() over (partition by doc_id order by size desc, chunk_id) as rank from c where doc_id is not null and content is not null qualify rank <= 8),
hh as (select h.*, c.doc_id, c.record from h join c using (chunk_id)),
per as (select query_id, doc_id, count(*) as n, min(rank) as first from hh where record group by all having count(*) >= 1),
dd as (select query_id, arg_max(doc_id, n * 1000 - first) as doc_id from per group by 1),
s as (select query_id, c.chunk_id, row_number() over (partition by query_id order by size desc, c.chunk_id) as n from dd join c using (doc_id) where not record and not exists (select 1 from h where h.query_id = dd.query_id and h.chunk_id = c.chunk_id) qualify n <= 2),
b as (select query_id, chunk_id, case when rank = 1 then 0.0 else 2.0 + rank end as place from h union all select query_id, chunk_id, 1.0 + n / 10.0 from s)
select query_id, chunk_id, row_number() over (partition by query_id order by place, chunk_id) as rank from b qualify rank <= 8"""
)
def rollup_summaries(spark, d):
    """Hits are the eight longest chunks of each document; one record among them brings in summaries, as the tables have few. The operator's own rule is in document_rollup."""
    from pyspark.sql import Window

    c = table(spark, d, "chunks").select(F.col("id").alias("chunk_id"), "doc_id", "content")
    w = Window.partitionBy("doc_id").orderBy(F.desc(F.length("content")), "chunk_id")
    h = c.where("doc_id is not null and content is not null").select(F.col("doc_id").alias("query_id"), "chunk_id", F.row_number().over(w).alias("rank")).where("rank <= 8")
    return R.rollup(h, c, k=8, least=1)


@query(
    """with h as (select doc_id as query_id, id as chunk_id, row_number() over (partition by doc_id order by id) as rank from chunks where doc_id is not null and content is not null qualify rank <= 4),
c as (select h.*, doc_name, content, is_table, '[' || doc_name || ']' || chr(10) || content as b from h join chunks on id = chunk_id)
select query_id, string_agg(b, chr(10) || chr(10) order by rank) as context, list_sort(list_distinct(list(doc_name) filter (trim(doc_name) <> '' and not regexp_matches(lower(doc_name), '[.](png|jpg|jpeg|webp|gif|bmp)$')))) as sources, coalesce(bool_or(is_table), false) as has_table from c group by 1"""
)
def context_blocks(spark, d):
    from pyspark.sql import Window

    c = table(spark, d, "chunks").select(F.col("id").alias("chunk_id"), "doc_id", "doc_name", "content", "is_table")
    w = Window.partitionBy("doc_id").orderBy("chunk_id")
    h = c.where("doc_id is not null and content is not null").select(F.col("doc_id").alias("query_id"), "chunk_id", F.row_number().over(w).alias("rank")).where("rank <= 4")
    return R.contexts(h, c.drop("doc_id")).drop("articles")


_PIPELINE = f"""
with pt as (select entry_id as doc_id, query as text, vector from semantic_cache), qt as (select entry_id as query_id, query, vector from cache_entries),
d as (select doc_id, {_W.format("text")} as w from pt),
p as (select doc_id, token, count(*) as tf from (select doc_id, unnest(w) as token from d) group by all),
q as (select query_id, token, count(*) as times from (select query_id, unnest({_W.format("query")}) as token from qt) group by all),
df as (select token, ln((select count(*) from d) / count(*)) + 1 as idf from p group by token),
m as (select query_id, doc_id, round(sum(times * idf * tf * idf), 6) as score, count(*)::double as overlap from p join df using (token) join q using (token) group by all),
sp as (select 'sparse' as method, query_id, doc_id, {_RANK} as rank from m qualify rank <= 100),
v as (select doc_id, vector::double[64] as e from pt where {_UNIT}), u as (select query_id, vector::double[64] as e from qt where {_UNIT}),
de as (select 'dense' as method, query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id) as rank from (select query_id, doc_id, round(array_cosine_similarity(u.e, v.e), 6) as score from u, v) qualify rank <= 100),
f as (select c as constant, query_id, doc_id, round(sum(1.0::double / (c + rank)), 9) as score from (select * from sp union all select * from de), (values (2), (60)) k(c) group by all),
n as (select constant, query_id, doc_id, row_number() over (partition by constant, query_id order by score desc, doc_id) as before from f qualify before <= 8),
r as (select constant, n.query_id, n.doc_id, before, round(least(1.0, coalesce(overlap, 0) / greatest(len(list_distinct({_W.format("query")})), 1) + 0.1::double / before), 6) as score from n left join m using (query_id, doc_id) join qt on qt.query_id = n.query_id),
t as (select *, row_number() over (partition by constant, query_id order by score desc, before) as rank from r qualify rank <= 4)
select constant, query_id, doc_id, rank, score from (select *, max(score >= 0.6) over (partition by constant, query_id) as ok from t) where not ok or score >= 0.6
"""


@query(_PIPELINE)
def hybrid_pipeline(spark, d):
    """Incoming questions against the store by their stored vectors and words: dense and sparse lists, fused with two constants, re-ranked, cut at a threshold."""
    p = table(spark, d, "semantic_cache").select(F.col("entry_id").alias("doc_id"), F.col("query").alias("text"), "vector")
    q = table(spark, d, "cache_entries").select(F.col("entry_id").alias("query_id"), "query", "vector")
    return R.pipeline(p, q, (2, 60), least=0.6)


@query()
def hybrid_context(spark, d):
    """The whole way from questions to contexts: chunks and questions embedded, ranked, rolled up and put together."""
    c = table(spark, d, "chunks").select(F.col("id").alias("chunk_id"), "doc_id", "doc_name", "content", "is_table")
    return R.answer_context(c, _questions(spark, d))


_TRUTH = """, t as (select e.item_id as query_id, doc_id from documents join eval_items e on contains(text, e.passage))
"""


@query(_LISTS + _TRUTH + """, hit as (select item_id, lang, bool_or(coalesce(method = 'overlap' and rank <= 4, false)) as before, bool_or(coalesce(method = 'bm25' and rank <= 4, false)) as after from eval_items join (select distinct query_id from t) k on k.query_id = item_id left join (select method, query_id, rank from lists join t using (query_id, doc_id)) h on h.query_id = item_id group by all)
select lang, count(*) as n, round(avg(before::int), 6) as before, round(avg(after::int), 6) as after from hit group by rollup (lang) having count(*) > 0""")
def grouped_before_after(spark, d):
    """Questions answered by the best four documents, by language: ranked by shared words before, by BM25 after."""
    from vellum.operators import evaluation

    items = table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), "lang", "passage")
    docs = _docs(spark, d)
    truth = _truth(docs, items)
    hit = _lists(spark, d).where("rank <= 4").join(truth, ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.bool_or(F.col("method") == "overlap").alias("before"), F.bool_or(F.col("method") == "bm25").alias("after"))
    x = items.select("query_id", "lang").join(truth.select("query_id").distinct(), "query_id").join(hit, "query_id", "left").fillna(False, ["before", "after"])
    return evaluation.before_after(x, "lang", "before", "after")


@query(_LISTS + """, a as (select query_id, doc_id from lists where method = 'bm25' and rank <= 4), b as (select query_id, doc_id from lists where method = 'overlap' and rank <= 4), g as (select b.query_id, count(*) as size, count(a.doc_id) as hit from b left join a using (query_id, doc_id) group by 1)
select count(*) as queries, round(avg(hit / size), 6) as overlap from g""")
def overlap_of_lists(spark, d):
    """How much of the four best by shared words BM25 has among its four best."""
    from vellum.operators import evaluation

    l = _lists(spark, d)  # noqa: E741
    return evaluation.overlap_at(l.where("method = 'bm25'"), l.where("method = 'overlap'"), 4)


@query(
    """with c as (select id as chunk_id, doc_id, case when length(content) % 5 < 4 then 'T > ' || length(content) % 90 || '. r' || chr(10) || content else content end as content from chunks), k as (select *, length(content) as size, coalesce(regexp_matches(split_part(content, chr(10), 1), ' > [0-9]+[.] .*$'), false) as record from c),
h as (select doc_id as query_id, chunk_id, row_number() over (partition by doc_id order by chunk_id) as rank from k where doc_id is not null and content is not null qualify rank <= 6),
per as (select query_id, k.doc_id, count(*) as n, min(rank) as first from h join k using (chunk_id) where record group by all having count(*) >= 3), dd as (select query_id, arg_max(doc_id, n * 1000 - first) as doc_id from per group by 1),
s as (select query_id, k.chunk_id, row_number() over (partition by query_id order by size desc nulls last, k.chunk_id) as n from dd join k using (doc_id) where not record and not exists (select 1 from h where h.query_id = dd.query_id and h.chunk_id = k.chunk_id) and content is not null qualify n <= 2),
b as (select query_id, chunk_id, case when rank = 1 then 0.0 else 2.0 + rank end as place from h union all select query_id, chunk_id, 1.0 + n / 10.0 from s)
select query_id, chunk_id, row_number() over (partition by query_id order by place, chunk_id) as rank from b qualify rank <= 4"""
)
def document_rollup(spark, d):
    """The operator's own rule, three records of six hits and four places; four fifths of the chunks are made records by rule."""
    from pyspark.sql import Window

    n = F.length("content")
    c = table(spark, d, "chunks").where("content is not null").select(F.col("id").alias("chunk_id"), "doc_id", F.when(n % 5 < 4, F.concat(F.lit("T > "), (n % 90).cast("string"), F.lit(". r\n"), "content")).otherwise(F.col("content")).alias("content"))
    h = c.where("doc_id is not null").select(F.col("doc_id").alias("query_id"), "chunk_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_id")).alias("rank")).where("rank <= 6")
    return R.rollup(h, c)
