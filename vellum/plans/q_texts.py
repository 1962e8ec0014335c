"""Queries of text helpers, pages, points and small reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import changes as X
from vellum.operators import html, memory, runs, telemetry
from vellum.plans.catalogue import query
from vellum.session import table
from vellum.sources import store

_BLANK = "[\\x{09}-\\x{0d}\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_ONE = f"trim(regexp_replace({{0}}, '{_BLANK.replace('{', '{{').replace('}', '}}')}+', ' ', 'g'), ' ')"


def _store(spark, d):
    return table(spark, d, "semantic_cache")


@query("select entry_id, nfc_normalize(query) as query from semantic_cache")
def composed_questions(spark, d):
    return _store(spark, d).select("entry_id", T.nfc(F.col("query")).alias("query"))


@query(f"select entry_id, lower({_ONE.format('nfc_normalize(query)')}) as query from semantic_cache")
def question_norms(spark, d):
    return _store(spark, d).select("entry_id", T.question_norm(F.col("query")).alias("query"))


@query(f"select doc_id, replace({_ONE.format('title')}, '|', '\\|') as cell, regexp_replace(regexp_replace(text, '<[bB][rR]\\s*/?>', ' ', 'g'), '<([^<>]+)>', '[\\1]', 'g') as text from documents")
def cells_and_tags(spark, d):
    return table(spark, d, "documents").select("doc_id", T.escaped_cell(F.col("title")).alias("cell"), T.tagless(F.col("text")).alias("text"))


@query(
    f"""with l as (select doc_id, string_split(text || chr(10) || text, chr(10)) as ls, list_transform(string_split(text || chr(10) || text, chr(10)), lambda x: lower({_ONE.format('x')})) as ks from documents where text is not null)
select doc_id, array_to_string(list_filter(ls, lambda x, i: ks[i] = '' or list_position(ks, ks[i]) = i), chr(10)) as text from l"""
)
def unique_lines(spark, d):
    """Texts that were put behind themselves, without the lines that came twice."""
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", T.unique_lines(F.concat("text", F.lit("\n"), "text")).alias("text"))


@query("select id, case when is_table then coalesce(content, '') || coalesce(doc_name, '') when content is null then '' else content end as said from chunks")
def said_texts(spark, d):
    """Streamed pieces that come as parts or as one text."""
    return table(spark, d, "chunks").select("id", T.said_text(F.when(F.col("is_table"), F.array("content", "doc_name")), F.when(F.col("is_table"), F.lit("")).otherwise(F.col("content"))).alias("said"))


@query("select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), '[\\t\\x{a0}]', ' ', 'g'), ' {2,}', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g'), ' ') as text from documents")
def cleaned_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clean_lines(F.col("text")).alias("text"))


@query("select doc_id, coalesce(regexp_matches(text, '(?m)^\\s*\\|.*\\n\\s*\\|[:\\-\\s|]*-[:\\-\\s|]*$'), false) as has_table from documents")
def documents_with_tables(spark, d):
    return table(spark, d, "documents").select("doc_id", T.has_table(F.col("text")).alias("has_table"))


@query(
    """with s as (select entry_id, answer as c, list_filter([':', ' - ', ' – ', ' — '], lambda x: contains(answer, x) and trim(substr(answer, 1, position(x in answer) - 1), ' ') <> '' and trim(substr(answer, position(x in answer) + length(x)), ' ') <> '')[1] as sep from semantic_cache where answer is not null)
select entry_id, trim(substr(c, 1, position(sep in c) - 1), ' ') as key, trim(substr(c, position(sep in c) + length(sep)), ' ') as value from s where sep is not null"""
)
def key_values(spark, d):
    """Answers read as a key and its value."""
    a = _store(spark, d).where("answer is not null").select("entry_id", T.key_value(F.col("answer")).alias("p")).where("p is not null")
    return a.select("entry_id", "p.key", "p.value")


@query("select doc_id, coalesce(nullif(substr(regexp_replace(regexp_replace(lower(coalesce(title, '')), '[^\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), ''), 'item') as slug from documents")
def title_slugs(spark, d):
    return table(spark, d, "documents").select("doc_id", T.slug(F.col("title")).alias("slug"))


@query("select doc_id, 'ART_' || doc_id || '_part-' || (doc_id % 7) || '.md' as file, '# Part' || chr(10) || 'Source: u' || doc_id || chr(10) || case when doc_id % 2 = 0 then 'Modified: 2024-05-01' || chr(10) else '' end || chr(10) || 'Text' as text, case when doc_id % 2 = 0 then '2024-05-01' end as marker from documents")
def article_files(spark, d):
    """Articles as Markdown files: their names, their text with its origin, and the time read back from it."""
    i = F.col("doc_id")
    m = F.when(i % 2 == 0, "2024-05-01")
    a = table(spark, d, "documents").select("doc_id", X.article_file(i, F.concat(F.lit("Part "), (i % 7).cast("string"), F.lit("-"), i.cast("string"))).alias("file"), X.article_text(F.lit("Part"), F.concat(F.lit("u"), i.cast("string")), F.lit(""), m, F.lit("Text")).alias("text"))
    return a.withColumn("marker", X.modified_marker(F.col("text")))


@query("select doc_id, case doc_id % 6 when 0 then 'wav' when 1 then 'mp3' when 2 then 'ogg' when 3 then 'flac' when 4 then null else 'm4a' end as format from documents")
def audio_formats(spark, d):
    """Formats of audio by their first bytes, written by rule."""
    k = F.col("doc_id") % 6
    h = F.when(k == 0, "524946460000000057415645").when(k == 1, "494433040000000000000000").when(k == 2, "4F6767530000000000000000").when(k == 3, "664C61430000000000000000").when(k == 4, "00FF").otherwise("000000186674797000000000")
    return table(spark, d, "documents").select("doc_id", T.audio_format(F.unhex(h)).alias("format"))


@query("with m as (select user_id, 'k' || (length(coalesce(title, '')) % 4) as key, arg_max(coalesce(title, ''), (coalesce(epoch_us(updated_at), 0), id)) as value, max(updated_at) as updated_at from chat_sessions where user_id is not null group by all) select user_id, key, value, row_number() over (partition by user_id order by updated_at desc nulls last, key) as place from m where user_id <> 'default_user'")
def memories_of_users(spark, d):
    """What is remembered of each user, the newest first; kinds are made of titles by rule."""
    s = table(spark, d, "chat_sessions").where("user_id is not null")
    at = F.struct(F.coalesce(F.unix_micros(F.col("updated_at").cast("timestamp")), F.lit(0)).alias("t"), "id")
    m = s.groupBy("user_id", F.concat(F.lit("k"), (F.length(F.coalesce("title", F.lit(""))) % 4).cast("string")).alias("key")).agg(F.max_by(F.coalesce("title", F.lit("")), at).alias("value"), F.max("updated_at").alias("updated_at"))
    return memory.of_user(m).select("user_id", "key", "value", "place")


_NEEDLES = ["học phí", "Đăng ký", "fee", "the", "khoa"]


@query(f"select entry_id, {' + '.join(f'contains(lower(coalesce(query, {chr(39) * 2})), {chr(39)}{n.lower()}{chr(39)})::int' for n in _NEEDLES)} as hits from semantic_cache")
def keyword_hits(spark, d):
    return _store(spark, d).select("entry_id", memory.hits(F.col("query"), _NEEDLES).alias("hits"))


@query(
    """with c as (select id, regexp_replace(filename, '\\.[^.]*$', '') as stem, coalesce(epoch_us(created_at), 0) as t from document_catalog), w as (select doc_id as post_id, 'VK_0_' || doc_id as stem from documents where doc_id % 3 = 0),
j as (select post_id, id, t from w join c using (stem) union all select post_id, id, t from w join c on regexp_extract(c.stem, '^VK_(\\d+)_', 1) = post_id::varchar)
select post_id, arg_max(id, (t, id)) as id from j group by 1"""
)
def stored_articles(spark, d):
    """The files of articles, by stem or by number."""
    w = table(spark, d, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("post_id"), F.concat(F.lit("VK_0_"), F.col("doc_id").cast("string")).alias("stem"))
    return X.stored_article(table(spark, d, "document_catalog"), w, "VK")


@query("with p as (select distinct case when file_size % 3 = 0 then filename when file_size % 3 = 1 then '/data/' || filename else 'old/place/' || filename end as path, '/data/' || filename as found from document_catalog where filename is not null) select path, found from p where found in (select '/data/' || filename from document_catalog where file_size % 5 > 0)")
def located_files(spark, d):
    """Where files lie that are named whole, by their name, or by a place they were at."""
    c = table(spark, d, "document_catalog").where("filename is not null")
    k = F.col("file_size") % 3
    p = c.select(F.when(k == 0, F.col("filename")).when(k == 1, F.concat(F.lit("/data/"), "filename")).otherwise(F.concat(F.lit("old/place/"), "filename")).alias("path"))
    return X.located(p, c.where("file_size % 5 > 0").select(F.concat(F.lit("/data/"), "filename").alias("name")), "/data")


@query(
    """with t as (select *, row_number() over (partition by doc_id, is_table order by id) - 1 as n from chunks where doc_id is not null and content is not null and is_table is not null), m as (select doc_id, max(n) + 1 as k from t where not is_table group by 1)
select doc_id, case when is_table then n + coalesce(k, 0) else n end as chunk, is_table, case when is_table then 'Table of ' else '' end || coalesce(doc_name, '') || chr(10) || content as embed_text from t left join m using (doc_id)"""
)
def point_payloads(spark, d):
    """Texts and tables of documents as one numbered list of points."""
    from pyspark.sql import Window

    c = table(spark, d, "chunks").where("doc_id is not null and content is not null and is_table is not null")
    n = F.row_number().over(Window.partitionBy("doc_id", "is_table").orderBy("id")) - 1
    c = c.withColumn("chunk", n).select("doc_id", "doc_name", "chunk", "content", "pages", "is_table")
    return store.payloads(c.where("not is_table").drop("is_table"), c.where("is_table").drop("is_table")).select("doc_id", "chunk", "is_table", "embed_text")


@query(
    """with v as (select entry_id, length(answer) as n from semantic_cache where answer is not null)
select (select count(*) from v) as n, (select min(n) from v) as least, (select median(n) from v) as median, (select max(n) from v) as most, (select list(entry_id order by n, entry_id) from (select * from v order by n, entry_id limit 6)) as lowest, (select list(entry_id order by n desc, entry_id) from (select * from v order by n desc, entry_id limit 6)) as highest"""
)
def answer_extremes(spark, d):
    """Lengths of answers in one row, with the six shortest and longest; a top-k report."""
    return runs.extremes(_store(spark, d).select("entry_id", F.length("answer").alias("n")), "n", "entry_id")


@query("with r as (select message_id, lower(trim(rating)) as up, coalesce(epoch_us(created_at), 0) as t, id from chat_feedbacks where message_id is not null and rating is not null), p as (select message_id, arg_min(up, (t, id)) as a, arg_max(up, (t, id)) as b from r group by 1) select message_id, a, b from p where a <> b")
def changed_ratings(spark, d):
    """Messages whose last rating isn't their first."""
    f = table(spark, d, "chat_feedbacks").where("message_id is not null and rating is not null")
    up, at = F.lower(F.trim("rating")), F.struct(F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(0)).alias("t"), "id")
    return runs.disagreements(f.groupBy("message_id").agg(F.min_by(up, at).alias("a"), F.max_by(up, at).alias("b")), "a", "b")


@query(
    """with e as (select case event_type when 'click' then 'first' else 'total' end as stage, value as ms from events where value is not null), s as (select stage, ms, row_number() over (partition by stage order by ms) - 1 as i, count(*) over (partition by stage) as n from e),
p as (select stage, round(max(ms) filter (i = round_even(0.5 * (n - 1), 0)), 1) as p50, round(max(ms) filter (i = round_even(0.95 * (n - 1), 0)), 1) as p95 from s group by 1)
select max(p50) filter (stage = 'first') as first_p50, max(p95) filter (stage = 'first') as first_p95, max(p50) filter (stage = 'total') as total_p50, max(p95) filter (stage = 'total') as total_p95 from p"""
)
def latency_summary(spark, d):
    """Times to the first piece and in all; clicks stand for the first, other events for the whole."""
    e = table(spark, d, "events").select(F.col("user_id").alias("request"), F.when(F.col("event_type") == "click", "first").otherwise("total").alias("stage"), F.col("value").alias("ms"))
    return telemetry.latency(e)


@query("select user_id as request, event_type as stage, min(value) as ms from events group by all")
def first_marks(spark, d):
    return telemetry.first_marks(table(spark, d, "events").select(F.col("user_id").alias("request"), F.col("event_type").alias("stage"), F.col("value").alias("ms")))


def _pages(spark, d):
    i = F.col("doc_id").cast("string")
    body = F.concat(F.lit('<html><body><h1 class="post-title">Notice '), i, F.lit('</h1><time datetime="2024-01-02">x</time><div class="entry-content"><h2>Part</h2><p>Text <b>'), i, F.lit('</b> of it</p><table><tr><td>a</td><td>b</td></tr><tr><td>1</td><td>2</td></tr></table><a href="/f/x'), i, F.lit('.pdf">File</a></div><a href="/news/note-'), i, F.lit('">more</a><a href="/tag/x-1">tag</a><a href="https://else.example/n-1">other</a></body></html>'))
    return table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.lit("https://site.example/p/").alias("url"), body.alias("html"))


@query("select doc_id as page_id, 'Notice ' || doc_id as title, '2024-01-02' as date, '### Part' || chr(10) || chr(10) || 'Text ' || doc_id || ' of it' || chr(10) || chr(10) || '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| 1 | 2 |' || chr(10) || chr(10) || '[File](https://site.example/f/x' || doc_id || '.pdf)' as content, 'https://site.example/f/x' || doc_id || '.pdf' as file from documents")
def page_articles(spark, d):
    """Pages, written by rule, read as articles with their attachments."""
    return html.articles(_pages(spark, d)).select("page_id", "title", "date", "content", F.col("attachments")[0]["url"].alias("file"))


@query("select doc_id as page_id, 0 as pos, 'https://site.example/news/note-' || doc_id as link from documents")
def page_links(spark, d):
    """Links of pages to articles of their site."""
    return html.page_links(_pages(spark, d))
