"""Queries of the cache: semantic_cache is the store, cache_entries what comes in."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import cache as C
from vellum.plans.catalogue import query
from vellum.session import table

_FILL = ", ".join(f"'{w}'" for w in dict.fromkeys(T.FILLERS))
_CONTENT = (
    "list_transform(list_filter(regexp_extract_all(regexp_replace(lower({0}), '(^|[^\\p{{L}}\\p{{N}}_])(như\\s+thế\\s+nào|thế\\s+nào|ra\\s+sao|như\\s+nào)($|[^\\p{{L}}\\p{{N}}_])', '\\1 thế_nào \\3', 'g'), '\\d+(?:[.,]\\d+)?|[\\p{{L}}\\p{{N}}_]+'), lambda x: not list_contains(["
    + _FILL
    + "], x)), lambda x: replace(x, ',', '.'))"
)
_NORM = "lower(trim(regexp_replace({0}, '[\\s\\x{{00a0}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g')))"


def _store(spark, d):
    return table(spark, d, "semantic_cache")


@query(f"select entry_id, {_CONTENT.format('query')} as words from semantic_cache where query is not null")
def content_words(spark, d):
    return _store(spark, d).where("query is not null").select("entry_id", T.content_words(F.col("query")).alias("words"))


@query("select entry_id, list_distinct(list_transform(regexp_extract_all(coalesce(query, ''), '\\d+(?:[.,]\\d+)?'), lambda x: replace(x, ',', '.'))) as numbers from semantic_cache where false union all select entry_id, list_sort(list_distinct(list_transform(regexp_extract_all(coalesce(query, ''), '\\d+(?:[.,]\\d+)?'), lambda x: replace(x, ',', '.')))) from semantic_cache")
def query_numbers(spark, d):
    return _store(spark, d).select("entry_id", F.array_sort(T.numbers(F.col("query"))).alias("numbers"))


@query(
    f"""with s as (select entry_id, created_at, vector, {_NORM.format("query")} as norm, array_to_string({_CONTENT.format("query")}, ' ') as canon, array_to_string(list_sort(list_distinct({_CONTENT.format("query")})), ' ') as bag from semantic_cache where query is not null and (select max(created_at) from semantic_cache) - created_at <= 31536000),
q as (select entry_id as query_id, vector, {_NORM.format("query")} as norm, array_to_string({_CONTENT.format("query")}, ' ') as canon, array_to_string(list_sort(list_distinct({_CONTENT.format("query")})), ' ') as bag from cache_entries where query is not null),
e as (select query_id, arg_max(entry_id, (created_at, entry_id)) as entry_id, 'exact' as match from q join s using (norm) where norm <> '' group by 1),
r1 as (select * from q where query_id not in (select query_id from e)),
c as (select query_id, arg_max(entry_id, (created_at, entry_id)) as entry_id, 'canonical' as match from r1 join s using (canon) where canon <> '' and s.norm <> '' group by 1),
r2 as (select * from r1 where query_id not in (select query_id from c)),
n as (select query_id, entry_id, list_cosine_similarity(r2.vector::double[], s.vector::double[]) as cosine from r2 join s using (bag) where bag <> '' and len(r2.vector) = 64 and len(s.vector) = 64),
m as (select query_id, arg_max(entry_id, (cosine, -entry_id)) as entry_id, 'semantic' as match from n where cosine >= 0.9 and not isnan(cosine) group by 1)
select * from e union all select * from c union all select * from m"""
)
def cache_lookup(spark, d):
    """Incoming questions against the store at the time of its last entry, with a year to live."""
    asked = table(spark, d, "cache_entries").where("query is not null").select(F.col("entry_id").alias("query_id"), "query", "vector")
    s = _store(spark, d)
    return C.lookup(asked, s, now=s.agg(F.max("created_at").alias("t")).scalar(), ttl=365 * 86400)


@query("select entry_id from (select * from semantic_cache order by last_accessed desc nulls last, entry_id limit 300) where (select max(last_accessed) from semantic_cache) - created_at <= 2592000")
def cache_warm(spark, d):
    s = _store(spark, d)
    return C.warm(s, s.agg(F.max("last_accessed").alias("t")).scalar(), 300, 30 * 86400).select("entry_id")


@query("select count(*) as n, count(*) filter (t - created_at > 7776000) as expired from semantic_cache, (select max(last_accessed) as t from semantic_cache)")
def cache_expired(spark, d):
    s = _store(spark, d)
    now = s.agg(F.max("last_accessed").alias("t")).scalar()
    return s.select(F.coalesce(C.expired(F.col("created_at"), now, 90 * 86400), F.lit(False)).alias("x")).agg(F.count("*").alias("n"), F.count_if("x").alias("expired"))


@query("select entry_id, hits from semantic_cache order by hits nulls first, last_accessed nulls first, entry_id limit greatest(0, (select count(*) - 1000 from semantic_cache))")
def cache_victims(spark, d):
    return C.victims(_store(spark, d), 1000).select("entry_id", "hits")


@query("with b as (select entry_id, normalized_query, created_at from semantic_cache union all select entry_id, normalized_query, created_at from cache_entries where trim(coalesce(query, '')) <> '' and length(trim(regexp_replace(coalesce(answer, ''), '[\\s\\x{00a0}]+', ' ', 'g'))) >= 10) select normalized_query, arg_max(entry_id, (coalesce(created_at, 0), entry_id)) as entry_id from b group by 1")
def cache_put(spark, d):
    """The store after all incoming entries were merged in."""
    cols = ["entry_id", "query", "normalized_query", "answer", "vector", "created_at", "last_accessed", "hits", "title"]
    return C.put(_store(spark, d).select(*cols), table(spark, d, "cache_entries").select(*cols)).select("normalized_query", "entry_id")


@query("select entry_id from semantic_cache where answer is null or trim(answer, ' ') not in (select trim(m.content, ' ') from chat_feedbacks f join (select distinct on (id) * from chat_messages) m on m.id = f.message_id where lower(trim(rating)) = 'dislike' and m.content is not null)")
def cache_without_disliked(spark, d):
    f = table(spark, d, "chat_feedbacks").where(F.lower(F.trim("rating")) == "dislike").select(F.col("message_id").alias("id"))
    a = table(spark, d, "chat_messages").dropDuplicates(["id"]).join(f, "id", "left_semi").where("content is not null").select(F.col("content").alias("answer"))
    return C.without_answers(_store(spark, d), a).select("entry_id")


@query("select count(*) as entries, sum(hits) as hits, round(100.0 * sum(hits) / (sum(hits) + count(*)), 6) as hit_rate, count(*) filter (vector is null) as without_vector from semantic_cache")
def cache_stats(spark, d):
    return _store(spark, d).agg(F.count("*").alias("entries"), F.sum("hits").alias("hits"), F.round(100.0 * F.sum("hits") / (F.sum("hits") + F.count("*")), 6).alias("hit_rate"), F.count_if(F.col("vector").isNull()).alias("without_vector"))


@query("select case when len(vector) = 64 then 'usable' when vector is null then 'null' else 'other' end as kind, count(*) as n from semantic_cache group by 1")
def cache_vector_kinds(spark, d):
    k = F.when(F.size("vector") == 64, "usable").when(F.col("vector").isNull(), "null").otherwise("other")
    return _store(spark, d).groupBy(k.alias("kind")).agg(F.count("*").alias("n"))


@query("select entry_id, round(sqrt(list_sum(list_transform(vector::double[], lambda x: x * x))), 4) as norm from semantic_cache where len(vector) = 64 and list_bool_and(list_transform(vector, lambda x: isfinite(x)))")
def vector_norms(spark, d):
    s = _store(spark, d).where("size(vector) = 64 and forall(vector, x -> not isnan(x) and abs(x) < double('inf'))")
    return s.select("entry_id", F.round(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), 4).alias("norm"))


@query()
def cache_fingerprint(spark, d):
    return C.fingerprint(_store(spark, d), "entry_id", "query", "answer")


@query(
    f"""with v as (select entry_id, vector::double[64] as e from semantic_cache where len(vector) = 64 and list_bool_and(list_transform(vector, lambda x: isfinite(x))) and list_max(list_transform(vector, lambda x: abs(x))) > 0),
c as (select a.entry_id, b.entry_id as other_id, array_cosine_similarity(a.e, b.e) as c from v a join v b on a.entry_id <> b.entry_id), n as (select entry_id, min(other_id) as other_id, max(c) as cosine from (select *, max(c) over (partition by entry_id) as best from c) where c >= best - 1e-6 group by 1),
e as (select entry_id, {_NORM.format("coalesce(query, '')")} as t, list_sort(list_distinct({_CONTENT.format("coalesce(query, '')")})) as w, case when json_valid(sources) then from_json(sources, '["VARCHAR"]') else [] end as r from semantic_cache),
p as (select case when a.t = b.t then 'same_text' when len(list_intersect(coalesce(a.r, []), coalesce(b.r, []))) > 0 then 'common_sources' else 'other_sources' end as kind, cosine, a.t = b.t or (len(a.w) > 0 and a.w = b.w) as same from n join e a using (entry_id) join e b on b.entry_id = other_id)
select t as threshold, kind, count(*) as n, count(*) filter (cosine >= t) as hits, count(*) filter (cosine >= t and same) as guarded_hits from p, (values (0.5::double), (0.7), (0.9)) v(t) group by all"""
)
def threshold_sweep(spark, d):
    """Hits of each entry with its nearest other, by kind: the same text, else common sources or other ones, where a hit is wrong. Guarded hits have equal content words, as lookups ask."""
    s = _store(spark, d)
    sources = F.coalesce(F.from_json("sources", "array<string>"), F.array().cast("array<string>"))
    words = F.array_sort(F.array_distinct(T.content_words(F.coalesce("query", F.lit("")))))
    e = s.select("entry_id", C.normalized(F.coalesce("query", F.lit(""))).alias("text"), words.alias("words"), sources.alias("sources")).dropDuplicates(["entry_id"])
    o = e.select(F.col("entry_id").alias("other_id"), F.col("text").alias("t"), F.col("words").alias("w"), F.col("sources").alias("r"))
    p = C.nearest_other(s).join(e, "entry_id").join(o, "other_id")
    common = F.exists("sources", lambda x: F.coalesce(F.array_contains("r", x), F.lit(False)))
    kind = F.when(F.col("text") == F.col("t"), "same_text").when(common, "common_sources").otherwise("other_sources")
    same = (F.col("text") == F.col("t")) | (F.size("words") > 0) & (F.col("words") == F.col("w"))
    return C.sweep(p.select(kind.alias("kind"), "cosine", same.alias("same_words")), [0.5, 0.7, 0.9])
