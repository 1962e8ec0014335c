"""Queries of evaluation, telemetry, speech and plain relational reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import markdown, speech
from vellum.functions import text as T
from vellum.operators import conversation, evaluation, memory, telemetry
from vellum.plans.catalogue import query
from vellum.session import table


@query(
    """with s as (select event_type as stage, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from events where value is not null)
select stage, any_value(n) as n, round(max(value) filter (i = round_even(0.5 * (n - 1), 0)), 1) as p50, round(max(value) filter (i = round_even(0.95 * (n - 1), 0)), 1) as p95, round(max(value), 1) as max from s group by 1"""
)
def stage_percentiles(spark, d):
    return telemetry.stage_stats(table(spark, d, "events"), "event_type", "value").withColumnRenamed("event_type", "stage")


@query("select event_id, event_type from (select *, row_number() over (partition by event_type order by ts desc, event_id desc) as n from events) where n <= 500")
def newest_events(spark, d):
    return telemetry.newest(table(spark, d, "events"), "event_type", "ts", "event_id", 500).select("event_id", "event_type")


@query(
    """with recursive h as (select event_id, user_id, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as n from events),
r as (select user_id, event_id, us, n, [us] as log, true as accepted from h where n = 1
 union all select h.user_id, h.event_id, h.us, h.n, case when len(list_filter(r.log, lambda x: h.us - x <= 86400000000)) < 2 then list_append(list_filter(r.log, lambda x: h.us - x <= 86400000000), h.us) else list_filter(r.log, lambda x: h.us - x <= 86400000000) end,
  len(list_filter(r.log, lambda x: h.us - x <= 86400000000)) < 2 from r join h on h.user_id = r.user_id and h.n = r.n + 1)
select user_id, count(*) as hits, count(*) filter (not accepted) as rejected from r group by 1"""
)
def rate_limit_log(spark, d):
    """At most two events a user and day, by a sliding log."""
    e = telemetry.rate_limited(table(spark, d, "events").select("user_id", "event_id", "ts"), 2, 86400)
    return e.groupBy("user_id").agg(F.count("*").alias("hits"), F.count_if(~F.col("accepted")).alias("rejected"))


@query("select event_type, count(*) as n, count(distinct user_id) as users, round(avg(value), 6) as mean from events group by 1")
def events_by_type(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.avg("value"), 6).alias("mean"))


@query("select json_extract_string(props, '$.k') as k, count(*) as n from events group by 1")
def event_properties(spark, d):
    return table(spark, d, "events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))


@query("select time_bucket(interval 1 day, ts) as day, event_type, count(*) as n from events group by all")
def events_by_day(spark, d):
    return table(spark, d, "events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "event_type").agg(F.count("*").alias("n"))


@query()
def bootstrap_interval(spark, d):
    """Mean length of answers with a confidence interval."""
    v = table(spark, d, "semantic_cache").select("entry_id", F.length("answer").cast("double").alias("value")).where("value is not null")
    b = evaluation.bootstrap(v)
    return b.select(F.round("mean", 6).alias("mean"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n")


@query(
    """with k as (select entry_id as id, query as question, source, lower(trim(regexp_replace(trim(regexp_replace(query, '[\\s\\x{00a0}\\x{2000}-\\x{200a}\\x{202f}\\x{3000}]+', ' ', 'g')), '\\s*[?]+$', ''))) as k from (select entry_id, query, title as source from semantic_cache) where query is not null)
select min(id) as id, arg_min(question, id) as question, coalesce(list_sort(list(distinct source) filter (source is not null)), []) as truths from k where k <> '' group by k"""
)
def clean_question_set(spark, d):
    """Distinct questions with their united labels."""
    s = table(spark, d, "semantic_cache").where("query is not null").select(F.col("entry_id").alias("id"), F.col("query").alias("question"), F.array("title").alias("truth"))
    return evaluation.clean_set(s)


@query("select entry_id, contains(lower(coalesce(answer, '')), 'chưa có thông tin') or contains(lower(coalesce(answer, '')), 'không có thông tin') or contains(lower(coalesce(answer, '')), 'chưa đề cập') or contains(lower(coalesce(answer, '')), 'không đề cập') or contains(lower(coalesce(answer, '')), 'không tìm thấy thông tin') or contains(lower(coalesce(answer, '')), 'chưa tìm thấy thông tin') as refused from semantic_cache")
def refusal_phrases(spark, d):
    return table(spark, d, "semantic_cache").select("entry_id", evaluation.says_nothing_found(F.col("answer")).alias("refused"))


@query()
def spoken_answers(spark, d):
    return table(spark, d, "semantic_cache").select("entry_id", speech.cut_at_sentence(speech.spoken(F.col("answer")), 600).alias("spoken"))


@query()
def shown_answers(spark, d):
    s = table(spark, d, "semantic_cache")
    return s.select("entry_id", markdown.shown(F.col("answer"), T.contains_any(T.plain_key(F.col("query")), T.TABLE_PHRASES)).alias("answer"))


@query()
def user_memories(spark, d):
    """What users said of themselves, the latest of each kind."""
    m = conversation.messages(table(spark, d, "chat_messages")).where("who = 'user' and sid is not null")
    s = table(spark, d, "chat_sessions").select(F.lower(F.trim("id")).alias("sid"), "user_id")
    return memory.remembered(m.join(s, "sid").select("user_id", "content", "created_at", "id"))


@query("select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by all")
def pricing_summary(spark, d):
    l = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))  # noqa: E741
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("select c_custkey, count(o_orderkey) as orders from customer left join orders on o_custkey = c_custkey group by 1")
def orders_per_customer(spark, d):
    """A left join with a count, 0 where nothing joins; orders are counted before the join."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"))


@query("select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey and s_nationkey = c_nationkey join nation on c_nationkey = n_nationkey group by 1")
def local_revenue(spark, d):
    l, o, c, s, n = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "supplier", "nation"))
    j = l.join(o, l.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey).join(s, (l.l_suppkey == s.s_suppkey) & (F.col("c_nationkey") == s.s_nationkey)).join(n, F.col("c_nationkey") == n.n_nationkey)
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
