"""Queries of evaluation: judgments, scores, intervals, agreement, evaluation sets, and what questions ask for."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import intent
from vellum.functions import text as T
from vellum.operators import evaluation as E
from vellum.plans.catalogue import query
from vellum.plans.q_state import _SQUEEZED
from vellum.session import table


def _store(spark, d):
    return table(spark, d, "semantic_cache")


def _raw():
    """A judge's reply for each entry, written by rule from its hits: fenced, broken, or with values of wrong types now and then."""
    h = F.col("hits")
    flag = lambda c: F.when(c, "true").otherwise("false")
    claims = F.concat(F.lit('[{"text": "a", "supported": '), flag(h % 2 == 0), F.lit('}, {"text": "b", "supported": "yes"}, {"text": "c", "supported": true}]'))
    facts = F.concat(F.lit('[{"fact": "x", "status": "covered"}, {"fact": "y", "status": "'), F.when(h % 3 == 0, "contradicted").when(h % 3 == 1, "missing").otherwise("odd"), F.lit('"}]'))
    body = F.concat(F.lit('{"claims": '), F.when(h % 7 == 0, "[]").otherwise(claims), F.lit(', "answer_relevance": '), (h % 9 - 1).cast("string"), F.lit(', "context_sufficient": '), flag(h % 5 != 0), F.lit(', "refused": '), F.when(h % 11 == 0, F.lit('"no"')).otherwise(flag(h % 4 == 0)), F.lit(', "key_facts": '), facts, F.lit("}"))
    return F.when(h % 13 == 0, F.lit("no JSON")).when(h % 13 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)


_JUDGED = """
with j as (select entry_id, hits as h, answer, hits % 13 <> 0 as ok from semantic_cache where hits is not null),
s as (select entry_id, h, answer, ok, case when ok then case when h % 7 = 0 then 0 else 2 end end as claims, case when ok then case when h % 7 = 0 then 0 else 1 + (h % 2 = 0)::int end end as supported, case when ok then least(5, greatest(1, h % 9 - 1)) end as relevance,
 case when ok then h % 5 <> 0 end as sufficient, case when ok and h % 11 <> 0 then h % 4 = 0 end as refused, case when ok then case when h % 3 = 2 then 1 else 2 end end as facts, case when ok then 1 end as covered, case when ok then h % 3 = 0 end as against from j)
"""


@query(_JUDGED + "select entry_id, claims, supported, relevance, sufficient, refused, facts from s")
def judgments(spark, d):
    s = _store(spark, d).where("hits is not null").select("entry_id", E.judgment(_raw()).alias("j"))
    j = F.col("j")
    return s.select("entry_id", F.size(j["claims"]).alias("claims"), F.size(F.filter(j["claims"], lambda c: c["supported"])).alias("supported"), j["answer_relevance"].alias("relevance"), j["context_sufficient"].alias("sufficient"), j["refused"].alias("refused"), F.size(j["key_facts"]).alias("facts"))


def _scores(spark, d):
    s = _store(spark, d).where("hits is not null")
    items = s.select(F.col("entry_id").alias("id"), (F.col("hits") % 10 == 0).alias("expect_refusal"), (F.col("hits") % 2 == 0).alias("has_facts"))
    kinds = F.explode(F.array(F.lit("plain"), F.lit("full"))).alias("config")
    answers = s.select(F.col("entry_id").alias("id"), F.concat(F.lit("Theo điều "), (F.col("hits") % 6).cast("string"), F.lit(".")).alias("answer"), kinds).where("config = 'full' or id % 3 = 0")
    judged = s.select(F.col("entry_id").alias("id"), _raw().alias("raw"), kinds).where("config = 'full' or id % 6 = 0")
    contexts = s.where("entry_id % 4 <> 1").select(F.col("entry_id").alias("id"), F.array(F.lit("Điều 1, điều 2"), F.lit("Điều 3")).alias("contexts"))
    return E.score_table(items, answers, judged, contexts)


_SCORES = (
    _JUDGED
    + """, r as (select s.*, config, config = 'full' or entry_id % 6 = 0 as seen from s, (values ('plain'), ('full')) v(config) where config = 'full' or entry_id % 3 = 0),
t as (select entry_id as id, config, h % 10 = 0 as expect_refusal, coalesce(case when seen then refused end, false) as refused, case when seen and claims > 0 then supported / claims end as faithfulness, case when seen then (relevance - 1) / 4 end as answer_relevance, case when seen then sufficient end as context_sufficient,
 case when seen and h % 2 = 0 then covered / facts end as correctness, case when seen and h % 2 = 0 then against end as contradicted, case when entry_id % 4 = 1 or (h % 6) not in (1, 2, 3) then [(h % 6)::int] else [] end as wrong_articles from r)
"""
)


@query(_SCORES + "select id, config, refused, round(faithfulness, 6) as faithfulness, answer_relevance, context_sufficient, correctness, contradicted, not refused as has_citation, wrong_articles from t")
def answer_scores(spark, d):
    """Scores of answers of two configurations, some not judged and some without contexts."""
    s = _scores(spark, d)
    return s.select("id", "config", s["refused"], F.round("faithfulness", 6).alias("faithfulness"), "answer_relevance", "context_sufficient", "correctness", "contradicted", "has_citation", "wrong_articles")


@query(
    _SCORES
    + """select config, round(avg(faithfulness), 6) as faithfulness, count(faithfulness) as n_faithfulness, round(avg(answer_relevance) filter (not expect_refusal), 6) as answer_relevance, round(avg(contradicted::int) filter (not expect_refusal), 6) as contradiction_rate, round(avg(refused::int) filter (expect_refusal), 6) as refusal_recall,
 round(avg(refused::int) filter (not expect_refusal and context_sufficient), 6) as false_refusal_rate, round(avg((not refused)::int) filter (not expect_refusal and not refused), 6) as citation_rate, round(avg((len(wrong_articles) > 0)::int) filter (not expect_refusal and not refused), 6) as wrong_citation_rate from t group by 1"""
)
def score_summary(spark, d):
    """Means of the scores by configuration, each over its own rows."""
    return E.summary(_scores(spark, d), ["config"]).select("config", "faithfulness", "n_faithfulness", "answer_relevance", "contradiction_rate", "refusal_recall", "false_refusal_rate", "citation_rate", "wrong_citation_rate")


@query(_SCORES + "select id from t where config = 'full' order by coalesce(faithfulness, 1), coalesce(answer_relevance, 1), id limit 10")
def worst_answers(spark, d):
    """The ten answers with the worst scores; a top-k report."""
    return E.worst(_scores(spark, d).where("config = 'full'"), 10).select("id")


@query(
    """with r as (select message_id, lower(trim(rating)) = 'like' as up, created_at, id from chat_feedbacks where message_id is not null and rating is not null),
p as (select message_id, arg_min(up, (coalesce(epoch_us(created_at), 0), id)) as a, arg_max(up, (coalesce(epoch_us(created_at), 0), id)) as b from r group by 1 having count(*) > 1),
g as (select count(*) as n, avg((a = b)::double) as po, avg(a::double) as pa, avg(b::double) as pb from p), k as (select *, pa * pb + (1 - pa) * (1 - pb) as pe from g)
select n, round(po, 6) as agreement, round(case when n = 0 then null when pe = 1 then (po = 1)::double else (po - pe) / (1 - pe) end, 6) as kappa from k"""
)
def kappa_agreement(spark, d):
    """Agreement of the first and the last rating of messages that were rated more than once."""
    f = table(spark, d, "chat_feedbacks").where("message_id is not null and rating is not null")
    up, at = F.lower(F.trim("rating")) == "like", F.struct(F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(0)).alias("t"), "id")
    g = f.groupBy("message_id").agg(F.min_by(up, at).alias("a"), F.max_by(up, at).alias("b"), F.count("*").alias("n")).where("n > 1")
    return E.agreement(g, "a", "b")


@query("select event_type, count(*) as n, median(value) as median, quantile_disc(value, 0) as least, max(value) filter (i = floor(0.95 * (n - 1))) as floor_rank from (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from events where value is not null) group by 1")
def median_times(spark, d):
    e = table(spark, d, "events")
    m = E.median_and_floor(e, ["event_type"], "value")
    return m.join(e.groupBy("event_type").agg(F.min("value").alias("least")), "event_type")


@query("select item_id as id, coalesce(list_sort(list_distinct(list(lang || ':' || fact) filter (fact is not null))), []) as key_facts from eval_items left join (values (0, 'a'), (0, 'b'), (1, 'a'), (7, 'c')) f(k, fact) on item_id % 5 = k group by 1")
def items_with_facts(spark, d):
    """Items with the facts known of them, some without any."""
    i = table(spark, d, "eval_items").select(F.col("item_id").alias("id"), "lang")
    facts = i.select("id", F.explode(F.when(F.col("id") % 5 == 0, F.array(F.lit("b"), F.lit("a"), F.lit("b"))).when(F.col("id") % 5 == 1, F.array(F.lit("a")))).alias("f"), "lang").select("id", F.concat("lang", F.lit(":"), "f").alias("fact"))
    return E.with_facts(i, facts)[0].select("id", "key_facts")


@query("select entry_id as id from cache_entries where entry_id % 3 = 0 and entry_id not in (select entry_id from semantic_cache)")
def orphan_facts(spark, d):
    """Facts that belong to no item: those of incoming entries, against the store."""
    facts = table(spark, d, "cache_entries").where("entry_id % 3 = 0").select(F.col("entry_id").alias("id"), F.col("query").alias("fact"))
    return E.with_facts(_store(spark, d).select(F.col("entry_id").alias("id")), facts)[1]


@query("with a as (select distinct doc_id from chunks where doc_id is not null), b as (select distinct id as doc_id from document_catalog) select doc_id, 'left' as side from a where doc_id not in (select doc_id from b) union all select doc_id, 'right' from b where doc_id not in (select doc_id from a)")
def decided_difference(spark, d):
    """Documents that only the chunks or only the catalog knows."""
    return E.difference(table(spark, d, "chunks").where("doc_id is not null").select("doc_id"), table(spark, d, "document_catalog").select(F.col("id").alias("doc_id")), "doc_id")


@query("select item_id as id, question, passage, false as expect_refusal from eval_items where item_id % 5 <> 0 union all select item_id, question, null, true from eval_items where item_id % 5 = 0")
def evaluation_union(spark, d):
    """Answerable and unanswerable questions as one set."""
    i = table(spark, d, "eval_items").select(F.col("item_id").alias("id"), "question", "passage")
    return E.united(i.where("id % 5 <> 0"), i.where("id % 5 = 0").drop("passage"))


@query("select doc_kind, case when avg(n_chars) is null then '-' else printf('%.2f', avg(n_chars)) || ' [' || printf('%.2f', min(n_chars)::double) || '-' || printf('%.2f', max(n_chars)::double) || '] (n=' || count(n_chars) || ')' end as shown from documents group by 1")
def formatted_means(spark, d):
    g = table(spark, d, "documents").groupBy("doc_kind").agg(F.avg("n_chars").alias("m"), F.min("n_chars").cast("double").alias("a"), F.max("n_chars").cast("double").alias("b"), F.count("n_chars").alias("n"))
    return g.select("doc_kind", E.shown_mean(F.col("m"), F.col("a"), F.col("b"), F.col("n")).alias("shown"))


@query()
def calibration_rows(spark, d):
    """Thirty entries for people to judge, by a seeded draw; the feature is the sample."""
    return E.calibration_sample(_store(spark, d).select("entry_id", "query", "answer"), "entry_id")


@query("select entry_id, list_sort(list_distinct(list_transform(regexp_extract_all(coalesce(query, ''), '\\d+(?:[.,]\\d+)?'), lambda x: replace(x, ',', '.')))) = list_sort(list_distinct(list_transform(regexp_extract_all(coalesce(answer, ''), '\\d+(?:[.,]\\d+)?'), lambda x: replace(x, ',', '.')))) as same from semantic_cache")
def same_numbers(spark, d):
    return _store(spark, d).select("entry_id", T.same_numbers(F.col("query"), F.col("answer")).alias("same"))


@query("select id, case when file_size < 1024 then file_size || ' B' when file_size < 1048576 then printf('%.1f KB', file_size / 1024) when file_size < 1073741824 then printf('%.1f MB', file_size / 1048576) else printf('%.1f GB', file_size / 1073741824) end as size from document_catalog where file_size is not null")
def file_sizes(spark, d):
    return table(spark, d, "document_catalog").where("file_size is not null").select("id", F.replace(T.size_text(F.col("file_size")), F.lit(","), F.lit("")).alias("size"))


@query("select id, trim(regexp_replace(replace(regexp_replace(filename, '[.][A-Za-z0-9]{1,5}$', ''), '_', ' '), '\\s+', ' ', 'g')) as title from document_catalog")
def pretty_titles(spark, d):
    return table(spark, d, "document_catalog").select("id", T.pretty_title(F.col("filename")).alias("title"))


@query("select entry_id, coalesce(regexp_matches(lower(answer), '(^|[^\\p{L}\\p{N}_])(điều|khoản)[ \\t\\n\\r\\f\\x{0b}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+\\p{Nd}'), false) as cites from semantic_cache")
def citing_answers(spark, d):
    return _store(spark, d).select("entry_id", T.cites(F.col("answer")).alias("cites"))


@query("select id, length(content) as n, case when content is null then null when length(content) <= 100 or position(' ' in right(content, 100)) = 0 then '' else trim(substr(right(content, 100), position(' ' in right(content, 100)) + 1), ' ') end as tail from chunks")
def chunk_tails(spark, d):
    """What the next chunk would repeat of each."""
    return table(spark, d, "chunks").select("id", F.length("content").alias("n"), T.overlap_tail(F.col("content"), 100).alias("tail"))


@query("select entry_id, greatest(1, floor(len(list_filter(regexp_split_to_array(coalesce(query, ''), '[\\s\\x{0b}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'), lambda x: x <> '')) * 1.3::double))::int as tokens, greatest(1, length(coalesce(query, '')) // 4)::int as estimated from semantic_cache")
def token_lengths(spark, d):
    return _store(spark, d).select("entry_id", T.token_length(F.col("query")).alias("tokens"), T.estimated_tokens(F.col("query")).alias("estimated"))


_PLAIN = "regexp_replace(regexp_replace(lower(replace(replace(strip_accents(coalesce({0}, '')), 'đ', 'd'), 'Đ', 'D')), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')"
_ANY = lambda phrases: "|".join(phrases)


@query(f"select item_id, regexp_matches({_PLAIN.format('question')}, '{_ANY(T.TABLE_PHRASES)}') as tabular, regexp_matches({_PLAIN.format('question')}, '{_ANY(intent.IMAGE_PHRASES)}') as image, regexp_matches(lower(question), '{_ANY(intent.TEXT_PHRASES)}') as words from eval_items")
def question_intents(spark, d):
    """What each question asks for: a table, a picture, or the text in a picture."""
    q = F.col("question")
    return table(spark, d, "eval_items").select("item_id", intent.wants_table(q).alias("tabular"), intent.about_image(q).alias("image"), intent.about_its_text(q).alias("words"))


@query("select vec_id, round(1 / (1 + exp(-x)), 9) as p from (select vec_id, list_sum(list_transform(embedding::double[], lambda v: v)) as x from embeddings)")
def logistic(spark, d):
    x = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.round(intent.sigmoid(x), 9).alias("p"))


@query("with w as (select entry_id, string_split(query, ' ') as w from semantic_cache where query is not null), s as (select entry_id, w, ceil(len(w) / 10.0)::int as step from w) select entry_id, step, ceil(len(w) / step)::int as pieces, array_to_string(w, ' ') as whole from s")
def replayed_pieces(spark, d):
    """Questions as they would be streamed: so many pieces, which give the whole again."""
    s = _store(spark, d).where("query is not null").select("entry_id", F.size(F.split("query", " ")).alias("n"), intent.replay(F.col("query")).alias("p"))
    return s.select("entry_id", F.ceil(F.col("n") / 10.0).cast("int").alias("step"), F.size("p").alias("pieces"), F.array_join("p", "").alias("whole"))


@query("select entry_id, sha256(query || '|' || coalesce(title, '') || '|+0%') as key from semantic_cache where query is not null and title is not null")
def speech_keys(spark, d):
    s = _store(spark, d).where("query is not null and title is not null")
    return s.select("entry_id", intent.speech_key(F.col("query"), F.col("title"), F.lit("+0%")).alias("key"))


@query("with p as (select id as doc_id, page, count(*)::double as w from (select id, unnest(pages) as page from chunks) where page is not null group by all), q as (select * from p where doc_id in (select id from chunks where length(content) % 50 = 0)), s as (select q.doc_id as query_id, p.doc_id, round(sum(p.w * q.w), 6) as score from p join q using (page) group by all) select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from s qualify rank <= 5")
def page_neighbours(spark, d):
    """Sparse search with pages as tokens: chunks that share pages with chosen ones."""
    from vellum.operators import models

    c = table(spark, d, "chunks")
    p = c.select(F.col("id").alias("doc_id"), F.explode("pages").alias("page")).where("page is not null").groupBy("doc_id", "page").agg(F.count("*").cast("float").alias("w"))
    p = p.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("page", "w"))).alias("sparse"))  # the pages of one chunk
    q = p.join(c.where("length(content) % 50 = 0").select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("query_id"), "sparse")
    return models.sparse_search(p, q, 5)
