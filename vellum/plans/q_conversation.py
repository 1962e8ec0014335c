"""Queries of conversations and feedback."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import conversation as C
from vellum.plans.catalogue import query
from vellum.session import table


def _m(spark, d):
    return C.messages(table(spark, d, "chat_messages"))


_M = """with m as (select *, case when lower(trim(role)) in ('user', 'human') then 'user' when lower(trim(role)) in ('model', 'assistant', 'bot') then 'model' end as who,
 nullif(lower(trim(session_id)), '') as sid from (select distinct on (id) * from chat_messages))
"""


@query(_M + ", w as (select id, sid, who, last_value(case when who = 'user' then content end ignore nulls) over (partition by sid order by id rows between unbounded preceding and 1 preceding) as question from m where sid is not null) select id, sid, question from w where who = 'model'")
def question_before(spark, d):
    return C.question_before(_m(spark, d))


@query(_M + "select sid, id, row_number() over (partition by sid order by back desc) as place from (select sid, id, row_number() over (partition by sid order by created_at desc nulls last, id desc) as back from m where sid is not null) where back <= 30")
def recent_history(spark, d):
    return C.recent(_m(spark, d)).select("sid", "id", "place")


@query(
    _M
    + """, t as (select sid, id, greatest(1, length(coalesce(content, '')) // 4) as cost from m where sid is not null),
f as (select *, row_number() over (partition by sid order by id) as n, sum(cost) over (partition by sid order by id desc) as run, sum(cost) over (partition by sid) as total from t),
s as (select sid, sum(cost) as start, max(id) as edge from f where n <= 2 group by 1)
select sid, id from f join s using (sid) where n <= 2 or total <= 400 or (id > edge and run <= 400 - start)"""
)
def history_budget(spark, d):
    return C.trim_history(_m(spark, d), 400)


@query(_M + "select sid, arg_max(content, coalesce(epoch_us(created_at), -1)::hugeint * 100000000000 + id) as content from m where who = 'model' and trim(regexp_replace(content, '[\\s\\x{00a0}\\x{2000}-\\x{200a}\\x{3000}]+', ' ', 'g')) <> '' and sid is not null group by 1")
def last_answers(spark, d):
    return C.last_said(_m(spark, d), "model")


@query(_M + "select s.id, s.user_id, coalesce(n.messages, 0) as messages from chat_sessions s left join (select sid, count(*) as messages from m where sid is not null group by 1) n on n.sid = lower(trim(s.id))")
def session_sizes(spark, d):
    return C.session_sizes(table(spark, d, "chat_sessions"), _m(spark, d))


@query(_M + ", c as (select sid, count(*) filter (who = 'user') as questions from m where sid is not null group by 1) select sid from c where questions = 1")
def sessions_to_name(spark, d):
    """Sessions with exactly one question get their title now."""
    return _m(spark, d).where("sid is not null").groupBy("sid").agg(F.count_if(F.col("who") == "user").alias("n")).where("n = 1").select("sid")


@query("select id, user_id, title, row_number() over (partition by user_id order by updated_at desc nulls last, id) as place from chat_sessions")
def sessions_of_owner(spark, d):
    """All sessions with their place among their owner's, the latest first; places run over months, so an owner of any size is spread."""
    from vellum.operators.segments import positions

    s = table(spark, d, "chat_sessions").withColumn("_o", -F.unix_micros(F.coalesce(F.col("updated_at").cast("timestamp"), F.timestamp_seconds(F.lit(-(1 << 33))))))
    return positions(s.fillna("", ["user_id"]), ["user_id"], "_o", "place", 30 * 86400e6, ["id"]).select("id", F.nullif("user_id", F.lit("")).alias("user_id"), "title", "place")


@query("select id, coalesce(title, 'New conversation') as title from chat_sessions where contains(lower(coalesce(title, 'New conversation')), 'h')")
def sessions_by_title(spark, d):
    t = F.coalesce("title", F.lit("New conversation"))
    return table(spark, d, "chat_sessions").where(F.contains(F.lower(t), F.lit("h"))).select("id", t.alias("title"))


@query(
    """with n as (select max(updated_at)::date as day from chat_sessions)
select id, case when updated_at is null or updated_at::date >= (select day from n) then 'today' when updated_at::date >= (select day from n) - 6 then 'week' else 'older' end as bucket from chat_sessions"""
)
def session_recency(spark, d):
    s = table(spark, d, "chat_sessions")
    now = s.agg(F.max("updated_at").alias("t")).scalar()
    return s.select("id", C.recency(F.col("updated_at"), now).alias("bucket"))


@query(
    _M
    + """, j as (select id, trim(source_docs) as j from m), k as (select id, j, case when j[1] in ('[', '{') and json_valid(j) then j end as ok from j),
l as (select id, case when ok[1] = '[' then from_json(ok, '["VARCHAR"]') when ok[1] = '{' then from_json(json_extract(ok, '$.sources'), '["VARCHAR"]') when j[1] not in ('[', '{') then list_transform(string_split(j, '|'), lambda x: trim(x)) end as s from k)
select id, list_filter(coalesce(s, []), lambda x: x is not null and trim(x) <> '') as sources from l"""
)
def message_sources(spark, d):
    return _m(spark, d).select("id", C.source_list(F.col("source_docs")).alias("sources"))


@query(
    _M
    + """, j as (select id, trim(source_docs) as j from m), k as (select id, j, case when j[1] in ('[', '{') and json_valid(j) then j end as ok from j),
l as (select id, unnest(case when ok[1] = '[' then from_json(ok, '["VARCHAR"]') when ok[1] = '{' then from_json(json_extract(ok, '$.sources'), '["VARCHAR"]') when j[1] not in ('[', '{') then list_transform(string_split(j, '|'), lambda x: trim(x)) end) as s from k)
select s as source, count(*) as messages from l where trim(s) <> '' group by 1 order by 2 desc, 1 limit 20"""
)
def most_used_sources(spark, d):
    s = _m(spark, d).select(F.explode(C.source_list(F.col("source_docs"))).alias("source"))
    return s.groupBy("source").agg(F.count("*").alias("messages")).orderBy(F.desc("messages"), "source").limit(20)


@query(
    _M
    + """, t as (select sid, id, who, content, created_at, row_number() over (partition by sid order by id) as n from m where sid is not null and who is not null),
l as (select sid, (n - 1) // 50 as page, n, '**' || case who when 'user' then 'User' else 'Assistant' end || '** (' || coalesce(strftime(created_at + interval 7 hour, '%d/%m/%Y %H:%M'), '-') || ')' || chr(10) || coalesce(content, '') as line from t)
select sid, page, string_agg(line, chr(10) || chr(10) order by n) as text from l group by all"""
)
def transcript_pages(spark, d):
    return C.transcript_pages(_m(spark, d), 50)


@query("select message_id, f.id, lower(trim(rating)) as rating, comment_text, created_at from (select *, row_number() over (partition by message_id order by created_at desc nulls last, id desc) as n from chat_feedbacks where message_id is not null) f where n = 1")
def latest_ratings(spark, d):
    return C.latest_ratings(table(spark, d, "chat_feedbacks"))


@query(
    """with f as (select created_at::date as day, lower(trim(rating)) as rating from chat_feedbacks where created_at is not null),
g as (select day, count(*) filter (rating = 'like') as l, count(*) filter (rating = 'dislike') as n from f group by 1), s as (select unnest(generate_series(min(day)::timestamp, max(day)::timestamp, interval 1 day))::date as day from g)
select s.day, coalesce(l, 0) as "like", coalesce(n, 0) as dislike from s left join g using (day)"""
)
def feedback_by_day(spark, d):
    return C.feedback_by_day(table(spark, d, "chat_feedbacks"))


@query("select lower(trim(rating)) as rating, count(*) as n from chat_feedbacks group by grouping sets ((lower(trim(rating))), ())")
def feedback_totals(spark, d):
    f = table(spark, d, "chat_feedbacks").select(F.lower(F.trim("rating")).alias("rating"))
    return f.rollup("rating").agg(F.count("*").alias("n"))


@query(_M + "select f.id, f.session_id, f.message_id, lower(trim(f.rating)) as rating, m.content as answer from chat_feedbacks f left join m on m.id = f.message_id where lower(trim(f.rating)) = 'dislike' order by f.created_at desc nulls last, f.id desc limit 100 offset 10")
def feedback_page(spark, d):
    """A page of negative feedback with the rated answers."""
    f = table(spark, d, "chat_feedbacks").where(F.lower(F.trim("rating")) == "dislike")
    j = f.join(_m(spark, d).select(F.col("id").alias("message_id"), F.col("content").alias("answer")), "message_id", "left")
    return j.orderBy(F.desc_nulls_last("created_at"), F.desc("id")).offset(10).limit(100).select("id", "session_id", "message_id", F.lower(F.trim("rating")).alias("rating"), "answer")


@query(
    _M
    + """, w as (select id, who, content, last_value(case when who = 'user' then content end ignore nulls) over (partition by sid order by id rows between unbounded preceding and 1 preceding) as question from m where sid is not null)
select f.id as feedback_id, w.question, w.content as answer from chat_feedbacks f join w on w.id = f.message_id where lower(trim(rating)) = 'dislike' and w.who = 'model' and w.question is not null"""
)
def feedback_to_eval(spark, d):
    """Candidates for evaluation from negative feedback: the question before the answer."""
    m = _m(spark, d)
    q = C.question_before(m).where("question is not null").join(m.select("id", F.col("content").alias("answer")), "id")
    f = table(spark, d, "chat_feedbacks").where(F.lower(F.trim("rating")) == "dislike").select(F.col("id").alias("feedback_id"), F.col("message_id").alias("id"))
    return f.join(q, "id").select("feedback_id", "question", "answer")


@query("select count(*) as rated, count(*) filter (m.id is null) as without_message from chat_feedbacks f left join (select distinct id from chat_messages) m on m.id = f.message_id")
def feedback_orphans(spark, d):
    f = table(spark, d, "chat_feedbacks").select(F.col("message_id").alias("id"))
    m = table(spark, d, "chat_messages").select("id", F.lit(1).alias("there")).distinct()
    return f.join(m, "id", "left").agg(F.count("*").alias("rated"), F.count_if(F.col("there").isNull()).alias("without_message"))


@query("select id from chat_sessions s where not exists (select 1 from chat_messages m where lower(trim(m.session_id)) = lower(trim(s.id)))")
def sessions_without_messages(spark, d):
    m = _m(spark, d).select("sid").distinct()
    return table(spark, d, "chat_sessions").withColumn("sid", F.lower(F.trim("id"))).join(m, "sid", "left_anti").select("id")


@query(
    _M
    + """, t as (select id, sid, who, case when who = 'user' then case when id % 5 = 0 then 'Giải thích thêm mục 2' else 'Học phí môn ' || id || ' là bao nhiêu' end when who = 'model' and id % 4 > 0 then 'Trả lời ' || id end as said from m where sid is not null),
w as (select *, last_value(case when who = 'user' then said end ignore nulls) over o as q, last_value(case when who = 'model' then said end ignore nulls) over o as a from t window o as (partition by sid order by id rows between unbounded preceding and 1 preceding))
select id, case when q is null and a is null then said else 'Question: ' || said || coalesce(chr(10) || 'Earlier question: ' || q, '') || coalesce(chr(10) || 'Earlier answer: ' || a, '') end as question from w where who = 'user' and id % 5 = 0"""
)
def followup_questions(spark, d):
    """Questions that refer back, rewritten with the exchange before them. What is said is written by rule, as the tables have no such questions; sessions, speakers and order are those of the tables."""
    from vellum.operators.segments import last_before

    m = _m(spark, d).where("sid is not null")
    asked = F.when(F.col("id") % 5 == 0, "Giải thích thêm mục 2").otherwise(F.format_string("Học phí môn %d là bao nhiêu", "id"))
    said = F.when(F.col("who") == "user", asked).when((F.col("who") == "model") & (F.col("id") % 4 > 0), F.format_string("Trả lời %d", "id"))
    m = m.select("id", "sid", "who", said.alias("content"))
    x = last_before(m, ["sid"], "id", F.when(F.col("who") == "user", F.col("content")), "before")
    x = last_before(x, ["sid"], "id", F.when((F.col("who") == "model") & (F.trim("content") != ""), F.col("content")), "answer")
    x = x.where("who = 'user' and content is not null")
    return x.where(C.refers_back(F.col("content"))).select("id", C.rewritten(F.col("content"), F.col("answer"), F.col("before")).alias("question"))


@query("select (select count(*) from chat_sessions) as sessions, count(distinct user_id) as owners, max(n) as most from (select user_id, count(*) as n from chat_sessions group by 1)")
def owner_load(spark, d):
    g = table(spark, d, "chat_sessions").groupBy("user_id").agg(F.count("*").alias("n"))
    return g.agg(F.sum("n").alias("sessions"), F.count("user_id").alias("owners"), F.max("n").alias("most"))


_ONE = "trim(regexp_replace(content, '[\\x{09}-\\x{0d}\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g'), ' ')"


@query(f"select id, case when length({_ONE}) > 60 then substring({_ONE}, 1, 60) || '...' else {_ONE} end as title from (select distinct on (id) * from chat_messages) where lower(trim(role)) in ('user', 'human') and content is not null")
def fallback_titles(spark, d):
    """Titles of user messages from their first 60 characters, in any script."""
    m = _m(spark, d).where("who = 'user' and content is not null")
    return m.select("id", T.short_title(F.col("content")).alias("title"))
