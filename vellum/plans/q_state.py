"""Queries of what changes state: the cache after use, sessions and catalog after edits, resumable work."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import cache as C
from vellum.operators import changes as X
from vellum.operators import conversation as V
from vellum.operators import memory, telemetry
from vellum.plans.catalogue import query
from vellum.plans.q_cache import _CONTENT, _store
from vellum.session import table

_COLS = ["entry_id", "query", "normalized_query", "answer", "vector", "created_at", "last_accessed", "hits", "title"]
_SQUEEZED = "trim(regexp_replace({0}, '[\\s\\x{{00a0}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g'))"
_KEY = "lower(replace(replace(replace({0}, ' ', ''), '_', ''), '-', ''))"


@query("select entry_id, coalesce(hits, 0) + coalesce(n, 0) as hits, greatest(last_accessed, t) as last_accessed from semantic_cache left join (select message_id % 2000 as entry_id, count(*) as n, max(epoch(created_at)) as t from chat_feedbacks where message_id is not null group by 1) using (entry_id)")
def cache_touched(spark, d):
    """The store after it served entries, named by the messages that were rated."""
    served = table(spark, d, "chat_feedbacks").select((F.col("message_id") % 2000).alias("entry_id"), (F.unix_micros(F.col("created_at").cast("timestamp")) / 1e6).alias("at"))
    return C.touched(_store(spark, d), served).select("entry_id", "hits", "last_accessed")


@query(
    f"""with b as (select entry_id, normalized_query, created_at, last_accessed, hits from semantic_cache union all select entry_id, normalized_query, created_at, last_accessed, hits from cache_entries where {_SQUEEZED.format("coalesce(query, '')")} <> '' and length({_SQUEEZED.format("coalesce(answer, '')")}) >= 10),
m as (select * from b qualify row_number() over (partition by normalized_query order by coalesce(created_at, 0) desc, entry_id desc) = 1)
select entry_id, hits from m order by hits desc nulls last, last_accessed desc nulls last, entry_id desc limit 1000"""
)
def cache_put_bounded(spark, d):
    """The store after all incoming entries were merged in and the least used were evicted."""
    return C.put_bounded(_store(spark, d).select(*_COLS), table(spark, d, "cache_entries").select(*_COLS), 1000).select("entry_id", "hits")


@query(f"with c as (select entry_id, created_at, array_to_string({_CONTENT.format('query')}, ' ') as canonical from semantic_cache where query is not null) select canonical, arg_max(entry_id, (created_at, entry_id)) as entry_id from c where canonical <> '' group by 1")
def cache_canonical_index(spark, d):
    return C.canonical_index(_store(spark, d))


@query(
    """with u as (select entry_id, vector::double[] as v, sqrt(list_sum(list_transform(vector::double[], lambda x: x * x))) as n from semantic_cache where len(vector) > 0),
k as (select * from u where n > 0 and isfinite(n)) select entry_id, round(v[1] / n, 5) as first, round(v[len(v)] / n, 5) as last from k where len(v) = (select arg_min(len(v), entry_id) from k)"""
)
def cache_matrix(spark, d):
    """The ends of the unit vectors that lookups compare with."""
    m = C.matrix(_store(spark, d))
    return m.select("entry_id", *(F.round(F.element_at("vector", i).cast("double"), 5).alias(n) for n, i in (("first", 1), ("last", -1))))


@query(
    """with m as (select title as key, min(normalized_query) as value from semantic_cache where title is not null group by 1), c as (select title as key, case when sum(hits) % 3 = 0 then null else max(normalized_query) end as value from cache_entries where title is not null group by 1)
select key, case when c.key is not null then c.value else m.value end as value from m full join c using (key) where case when c.key is not null then c.value else m.value end is not null"""
)
def cache_meta(spark, d):
    """Pairs of the store with changes over them; a null deletes."""
    m = _store(spark, d).where("title is not null").groupBy(F.col("title").alias("key")).agg(F.min("normalized_query").alias("value"))
    c = table(spark, d, "cache_entries").where("title is not null").groupBy(F.col("title").alias("key")).agg(F.when(F.sum("hits") % 3 != 0, F.max("normalized_query")).alias("value"))
    return C.with_meta(m, c)


@query(
    """with u as (select entry_id, vector::double[] as v, list_max(list_transform(vector::double[], lambda x: abs(x))) as big from semantic_cache where len(vector) > 0 and list_bool_and(list_transform(vector, lambda x: isfinite(x))))
select entry_id, list_transform(v, lambda x: round(x * 127 / big)::int) as code from u where big > 0"""
)
def vectors_int8(spark, d):
    s = _store(spark, d).where("vector is not null and size(vector) > 0 and forall(vector, x -> not isnan(x) and abs(x) < double('inf'))")
    return s.select("entry_id", C.int8(F.col("vector")).alias("q")).where("q is not null").select("entry_id", F.col("q.values").cast("array<int>").alias("code"))


@query("select entry_id from semantic_cache where entry_id not in (select entry_id from semantic_cache where hits = 0 and entry_id is not null)")
def cache_removed(spark, d):
    """The store without the entries that nobody asked for."""
    s = _store(spark, d)
    return C.without(s, s.where("hits = 0").select("entry_id")).select("entry_id")


@query("with f as (select filename as name, file_size as size, created_at as changed from document_catalog where file_size is not null and created_at is not null), r as (select name, size, sum(size) over (order by changed::date desc, changed desc, name) as run from f) select name, size from r where run <= (select sum(size) // 2 from f)")
def newest_files_that_fit(spark, d):
    """Files kept when the oldest go until half of the bytes are left."""
    f = table(spark, d, "document_catalog").select(F.col("filename").alias("name"), F.col("file_size").alias("size"), F.col("created_at").alias("changed")).where("size is not null and changed is not null")
    half = f.agg(F.expr("sum(size) div 2").alias("s")).scalar()
    return C.keep_newest(f, half).select("name", "size")


@query("with g as (select lower(trim(id)) as sid from chat_sessions where title is null) select 'sessions' as kind, count(*) as n from chat_sessions where lower(trim(id)) not in (select sid from g where sid is not null) union all select 'messages', count(*) from (select distinct on (id) * from chat_messages) where session_id is null or lower(trim(session_id)) not in (select sid from g)")
def sessions_after_delete(spark, d):
    """What is left when untitled sessions are deleted with their messages."""
    s = table(spark, d, "chat_sessions")
    left, m = V.delete_sessions(s, V.messages(table(spark, d, "chat_messages")), s.where("title is null").select("id"))
    n = lambda df, k: df.agg(F.lit(k).alias("kind"), F.count("*").alias("n"))
    return n(left, "sessions").unionByName(n(m, "messages"))


@query(
    f"""with c as (select session_id as id, substr({_SQUEEZED.format("comment_text")}, 1, 100) as title, created_at as t from chat_feedbacks where comment_text is not null), l as (select id, arg_max(title, (t, title)) as title, max(t) as t from c where title <> '' group by 1)
select s.id, coalesce(l.title, s.title) as title, greatest(updated_at, l.t) as updated_at from chat_sessions s left join l using (id)"""
)
def renamed_sessions(spark, d):
    """Sessions that take the last comment on them as their title."""
    c = table(spark, d, "chat_feedbacks").where("comment_text is not null").select(F.col("session_id").alias("id"), F.col("comment_text").alias("title"), F.col("created_at").alias("at"))
    return V.renamed(table(spark, d, "chat_sessions"), c).select("id", "title", "updated_at")


_TOP = "(select user_id from chat_sessions group by 1 order by count(*) desc, user_id limit 1)"


@query(f"select case when user_id = {_TOP} then 'archive' else user_id end as user_id, count(*) as sessions from chat_sessions group by 1")
def reassigned_sessions(spark, d):
    """Sessions an owner after those of the busiest one were handed over."""
    s = table(spark, d, "chat_sessions")
    top = s.groupBy("user_id").count().orderBy(F.desc("count"), "user_id").limit(1).select("user_id").scalar()
    return V.reassigned(s, top, "archive").groupBy("user_id").agg(F.count("*").alias("sessions"))


@query("select id, user_id from chat_sessions where user_id = lower(user_id) || ''")
def sessions_of_caller(spark, d):
    """Sessions whose owner is the caller, by a caller that writes ids in small letters."""
    return V.owned_by(table(spark, d, "chat_sessions"), F.lower("user_id")).select("id", "user_id")


@query(
    "with m as (select nullif(lower(trim(session_id)), '') as sid, id, created_at, 'p' || id || '.png' as image from (select distinct on (id) * from chat_messages) where id % 7 = 0) select sid, arg_max(id, coalesce(epoch_us(created_at), -1)::hugeint * 100000000000 + id) as id, [arg_max(image, coalesce(epoch_us(created_at), -1)::hugeint * 100000000000 + id)] as images from m where sid is not null group by 1"
)
def last_images(spark, d):
    """The newest message with an uploaded picture of each session; every seventh message has one, written by rule."""
    meta = F.when(F.col("id") % 7 == 0, F.format_string('{"kind": "user_image", "images": ["p%d.png"]}', "id")).when(F.col("id") % 7 == 1, F.lit('{"kind": "user_image", "images": []}')).otherwise(F.lit('{"kind": "other", "images": ["x"]}'))
    return V.last_image(V.messages(table(spark, d, "chat_messages")).withColumn("source_docs", meta))


@query("select id, strftime(created_at, '%Y-%m-%dT%H:%M:%S+00:00') as at from chat_sessions")
def session_times(spark, d):
    return table(spark, d, "chat_sessions").select("id", V.utc(F.col("created_at")).alias("at"))


@query(f"with t as (select entry_id, regexp_replace({_SQUEEZED.format('title')}, '^[\\s\"''“”‘’.]+|[\\s\"''“”‘’.]+$', '', 'g') as title from (select entry_id, '\"' || title || '.\"' as title from semantic_cache)) select entry_id, case when title <> '' and length(title) <= 80 then title end as title from t")
def cleaned_titles(spark, d):
    """Titles as a model gives them, in quotes and with a stop."""
    return _store(spark, d).select("entry_id", V.clean_title(F.concat(F.lit('"'), F.col("title"), F.lit('."'))).alias("title"))


@query("select id from document_catalog where filename is null or not starts_with(filename, 'VK_1')")
def catalog_without_prefix(spark, d):
    return X.without_prefix(table(spark, d, "document_catalog"), "filename", "VK_1").select("id")


@query(
    """with c as (select * from document_catalog where starts_with(filename, 'VK_'))
select count(*) as documents, count(*) filter (status = 'ready') as ready, coalesce(sum(chunk_count), 0) as chunks, (select list(filename order by coalesce(epoch_us(created_at), 0) desc, id) from (select * from c order by created_at desc nulls last, id limit 5)) as newest from c"""
)
def prefix_status(spark, d):
    return X.prefix_status(table(spark, d, "document_catalog"), "VK_")


@query(
    """with n as (select id, filename as a, original_name as b, regexp_replace(regexp_replace(original_name, '.*[/\\\\]', ''), '\\.[^.]*$', '') || lower(regexp_extract(filename, '\\.[^./\\\\]+$')) as c from document_catalog)
select id, list_filter([a, case when b is distinct from a then b end, case when c is distinct from a and c is distinct from b then c end], lambda x: x is not null) as names from n"""
)
def candidate_names(spark, d):
    return X.candidate_names(table(spark, d, "document_catalog"))


@query(
    f"""with n as (select distinct replace(doc_name, ' ', '%20') as name from chunks where doc_name is not null), pairs as (select name, name as asked, 0 as late from n union all select name, replace(name, '%20', ' '), 1 from n where contains(name, '%20')),
k as (select name, late, {_KEY.format("asked")} as k, {_KEY.format("regexp_replace(asked, '[.][^.]*$', '')")} as s from pairs),
c as (select id, created_at, {_KEY.format("filename")} as f, {_KEY.format("original_name")} as o, {_KEY.format("regexp_replace(original_name, '[.][^.]*$', '')")} as os from document_catalog),
a as (select name, late, id, created_at, 1 as tier from k join c on k = f union all select name, late, id, created_at, 2 from k join c on k = o union all select name, late, id, created_at, 3 from k join c on s = os)
select name, id, tier from (select *, row_number() over (partition by name order by late, tier, coalesce(epoch_us(created_at), 0) desc, id) as r from a) where r = 1"""
)
def requested_names(spark, d):
    """Names as a browser sends them, with blanks escaped."""
    n = table(spark, d, "chunks").select(F.replace("doc_name", F.lit(" "), F.lit("%20")).alias("name"))
    return X.resolve_requested(n, table(spark, d, "document_catalog"))


@query("select id, file_size % 3 <> 2 as inside from document_catalog")
def paths_inside(spark, d):
    """Paths that stay below the root or climb out of it, by rule."""
    k = F.col("file_size") % 3
    p = F.concat(F.lit("/data/docs/"), F.when(k == 0, "./a/").when(k == 1, "a/../b//").otherwise("a/../../"), "filename")
    return table(spark, d, "document_catalog").select("id", X.inside(p, "/data/docs").alias("inside"))


@query("select item_id, config from eval_items, (values ('plain'), ('full')) v(config) where not ((config = 'plain' and item_id % 3 = 0) or (config = 'full' and item_id % 4 = 1))")
def open_work(spark, d):
    """Items and configurations that a run which broke off has still to do."""
    i = table(spark, d, "eval_items").select("item_id")
    want = i.select("item_id", F.explode(F.array(F.lit("plain"), F.lit("full"))).alias("config"))
    done = i.where("item_id % 3 = 0").select("item_id", F.lit("plain").alias("config")).unionByName(i.where("item_id % 4 = 1").select("item_id", F.lit("full").alias("config")))
    return X.todo(want, done, ["item_id", "config"])


@query("select id, coalesce(regexp_matches(lower(error_msg), '429|500|502|503|504|timeout|timed out|rate limit|overloaded|unavailable|connection'), false) as again from document_catalog")
def retryable_errors(spark, d):
    return table(spark, d, "document_catalog").select("id", X.retryable(F.col("error_msg")).alias("again"))


@query("with s as (select *, title as k from (select entry_id, title, hits from semantic_cache union all select entry_id, title, hits from cache_entries) where title is not null) select k as title, arg_max(entry_id, (hits, entry_id)) as entry_id, max(hits) as hits from s group by 1")
def upserted_titles(spark, d):
    """Entries of the store and what comes in merged by title, the one with most hits on top."""
    one = lambda t: table(spark, d, t).where("title is not null").select("title", "entry_id", "hits", F.struct("hits", "entry_id").alias("place"))
    return X.upsert(one("semantic_cache"), one("cache_entries"), ["title"], "place").drop("place")


@query(
    """select doc_id as post_id, case when length(coalesce(text, '')) < 50 and doc_id % 5 <> 0 then 'skipped' when doc_id % 4 = 0 then 'new' when doc_id % 4 = 1 and crawled_at is not null then 'skipped' else 'updated' end as action from documents"""
)
def article_actions(spark, d):
    """Articles against what was taken in before, by rule: a quarter unknown, a quarter unchanged, others changed or failed before."""
    x = table(spark, d, "documents")
    at = F.col("crawled_at").cast("string")
    inc = x.select(F.col("doc_id").alias("post_id"), at.alias("modified"), F.col("text").alias("content"), F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("a.pdf"))).otherwise(F.array().cast("array<string>")).alias("attachments"))
    k = F.col("doc_id") % 4
    known = x.where(k != 0).select(F.col("doc_id").alias("post_id"), F.when(k == 2, F.lit("older")).otherwise(at).alias("modified"), F.when(k == 3, "failed").otherwise("ok").alias("status"))
    return X.article_actions(inc, known)


@query("with a as (select case when status = 'ready' then 'new' when status = 'error' then 'failed' else 'skipped' end as action, error_msg as error from document_catalog) select 'r1' as run_id, 'manual' as trigger, count(*) filter (action = 'new') as new, count(*) filter (action = 'skipped') as skipped, count(*) filter (action = 'failed') as failed from a")
def run_totals(spark, d):
    """A run's row from the results of its documents."""
    from vellum.sources import sinks

    a = F.when(F.col("status") == "ready", "new").when(F.col("status") == "error", "failed").otherwise("skipped")
    return sinks.run_log(table(spark, d, "document_catalog").select(a.alias("action"), F.col("error_msg").alias("error")), "r1", "manual").select("run_id", "trigger", "new", "skipped", "failed")


@query("with c as (select file_type as component, bool_and(status <> 'error') as ok from document_catalog where file_type is not null and status is not null group by 1) select bool_and(ok) as ok, coalesce(list_sort(list(component) filter (not ok)), []) as failing from c")
def health(spark, d):
    c = table(spark, d, "document_catalog").where("file_type is not null and status is not null").groupBy(F.col("file_type").alias("component")).agg(F.bool_and(F.col("status") != "error").alias("ok"))
    return telemetry.healthy(c)


@query("select user_id as request, event_type as stage, round(sum(value::decimal(18, 4)), 1)::double as ms from events group by all")
def stage_totals(spark, d):
    return telemetry.totals(table(spark, d, "events").select(F.col("user_id").alias("request"), F.col("event_type").alias("stage"), F.col("value").cast("decimal(18,4)").alias("ms"))).withColumn("ms", F.col("ms").cast("double"))


@query("select event_id, '10.0.' || (user_id % 200) || '.1' as client from events")
def client_addresses(spark, d):
    """The first address of chains of forwarders, written by rule."""
    a = F.concat(F.lit(" 10.0."), (F.col("user_id") % 200).cast("string"), F.lit(".1 , 192.168.0.1"))
    return table(spark, d, "events").select("event_id", telemetry.client(a).alias("client"))


@query("select id, case when regexp_matches(coalesce(nullif(trim(user_id, ' '), ''), nullif(trim(title, ' '), '')), '^[A-Za-z0-9_.@-]{1,64}$') and coalesce(nullif(trim(user_id, ' '), ''), nullif(trim(title, ' '), '')) <> 'default_user' then coalesce(nullif(trim(user_id, ' '), ''), nullif(trim(title, ' '), '')) end as caller from chat_sessions")
def callers(spark, d):
    return table(spark, d, "chat_sessions").select("id", memory.owner(F.col("user_id"), F.col("title")).alias("caller"))


@query(f"select entry_id, case when len(source_names) = 0 or source_names is null then null else '{{\"sources\":' || to_json(source_names)::varchar || '}}' end as meta from cache_entries")
def packed_meta(spark, d):
    return table(spark, d, "cache_entries").select("entry_id", V.pack_meta(F.col("source_names"), F.array().cast("array<string>"), F.lit("")).alias("meta"))


@query("select id, lower(regexp_replace(filename, '[.][^.]*$', '')) as stem from document_catalog")
def trimmed_names(spark, d):
    return table(spark, d, "document_catalog").select("id", F.lower(T.file_stem(F.col("filename"))).alias("stem"))
