"""Queries of documents, chunks and the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import changes as X
from vellum.operators import structure as S
from vellum.plans.catalogue import query
from vellum.session import table

_LINES = """with raw as (select doc_id, regexp_split_to_array(text, '\\r\\n|\\r|\\n') as ls from documents where text is not null),
l0 as (select doc_id, unnest(generate_series(0, len(ls) - 1)) as pos, unnest(ls) as line from raw),
l as (select doc_id, pos, regexp_replace(line, '^[\\s\\x{00a0}\\x{2000}-\\x{200a}\\x{202f}\\x{3000}]+|[\\s\\x{00a0}\\x{2000}-\\x{200a}\\x{202f}\\x{3000}]+$', '', 'g') as line from l0),
n as (select * from l where line <> '' and not regexp_matches(line, '^[-=_*]{5,}$'))
"""
_LEVEL = """case when regexp_matches(low, '^(?:chương|chuong|phần|phan) ') then 1 when regexp_matches(low, '^(?:mục|muc) ') then 2 when regexp_matches(low, '^(?:điều|dieu)\\s+(?:\\d+|[ivxlcdm]+)') then 2
 when regexp_matches(low, '^(?:khoản|khoan)\\s+\\d+') then 3 when regexp_matches(low, '^(?:điểm|diem)\\s+[a-z]|^[a-z]\\)\\s+') then 4 when regexp_matches(low, '^[ivxlcdm]*[ivxlc][ivxlcdm]*[.)]\\s+') then 1
 when regexp_matches(t, '^\\d+(?:\\.\\d+){0,5}[.)]?\\s+') then least(4, 1 + length(regexp_extract(t, '^(\\d+(?:\\.\\d+){0,5})[.)]?\\s+', 1)) - length(replace(regexp_extract(t, '^(\\d+(?:\\.\\d+){0,5})[.)]?\\s+', 1), '.', ''))) end"""


def _docs(spark, d):
    return table(spark, d, "documents")


@query(_LINES + "select doc_id, count(*) as lines, max(length(line)) as longest from n group by 1")
def document_lines(spark, d):
    return S.lines(_docs(spark, d)).groupBy("doc_id").agg(F.count("*").alias("lines"), F.max(F.length("line")).alias("longest"))


@query(
    _LINES
    + f""", s as (select *, regexp_replace(line, '[\\s\\x{{00a0}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{3000}}]+', ' ', 'g') as t from n), w as (select *, lower(t) as low from s), v as (select *, {_LEVEL} as lv, regexp_matches(t, '\\p{{L}}') and upper(t) = t and lower(t) <> t as caps from w)
select doc_id, pos, line, coalesce(lv, case when caps and length(t) <= 120 then 1 when regexp_matches(low, '^điều([^\\p{{L}}\\p{{N}}_]|$)') then 2 else 3 end) as level from v
where length(t) <= 180 and (lv is not null or (caps and length(t) <= 120) or regexp_matches(low, '^(điều|khoản|mục|phần|chương)([^\\p{{L}}\\p{{N}}_]|$)'))"""
)
def heading_levels(spark, d):
    return S.headings(_docs(spark, d)).select("doc_id", "pos", "line", "level")


@query(
    _LINES
    + """, a as (select *, regexp_replace(line, '[^\\p{L}]', '', 'g') as le from n), b as (select doc_id, pos, line, length(line) <= 150 and not regexp_matches(line, '^[-+*]') and length(le) >= 3 and upper(le) = le and lower(le) <> le as s from a),
c as (select *, not s and length(line) <= 160 and regexp_matches(line, '^\\d+\\.\\s+\\S') as r from b),
e as (select *, sum((s or r)::int) over w as island, last_value(case when s then line end ignore nulls) over w as section from c window w as (partition by doc_id order by pos))
select doc_id, any_value(section) as section, max(case when r then line end) as record, min(pos) as from_pos, count(*) filter (not s and not r) as lines, coalesce(string_agg(line, chr(10) order by pos) filter (not s and not r), '') as content from e group by doc_id, island"""
)
def line_sections(spark, d):
    return S.sections(_docs(spark, d))


@query(
    """with w as (select doc_id, list_filter(regexp_split_to_array(text, '[\\s\\x{00a0}\\x{0085}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'), lambda x: x <> '') as w from documents where text is not null),
e as (select doc_id, w, unnest(range(0, greatest(1, len(w) - 50), 200)) as start from w where len(w) > 0)
select doc_id, start, array_to_string(w[start + 1:start + 250], ' ') as content from e where length(array_to_string(w[start + 1:start + 250], ' ')) > 30"""
)
def word_windows(spark, d):
    return S.word_windows(_docs(spark, d))


_WS = "[ \\t\\n\\x{0b}\\f\\r]"


@query(
    f"""with m as (select doc_id, regexp_replace(trim(text, ' '), '([.!?])({_WS}+)', '\\1' || chr(31) || '\\2', 'g') as t from documents where text is not null),
u as (select doc_id, regexp_replace(regexp_replace(t, '(^|[^\\p{{L}}\\p{{N}}\\p{{M}}_])(\\d{{1,2}}|[a-zA-Z])[.]' || chr(31), '\\1\\2.', 'g'), '(^|[^\\p{{L}}\\p{{N}}\\p{{M}}_])(\\d{{1,2}}|[a-zA-Z])[.]' || chr(31), '\\1\\2.', 'g') as t from m),
l as (select doc_id, list_filter(list_transform(regexp_split_to_array(t, chr(31) || '{_WS}+'), lambda x: trim(x, ' ')), lambda x: x <> '') as s from u)
select doc_id, unnest(range(0, len(s)))::int as pos, unnest(s) as sentence from l"""
)
def document_sentences(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(S.split_sentences(F.col("text"))).alias("pos", "sentence"))


@query()
def packed_chunks(spark, d):
    return S.chunks(_docs(spark, d))


@query(
    _LINES
    + f""", s as (select *, regexp_replace(line, '[\\s\\x{{00a0}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{3000}}]+', ' ', 'g') as t from n), w as (select *, lower(t) as low from s), v as (select *, {_LEVEL} as lv, regexp_matches(t, '\\p{{L}}') and upper(t) = t and lower(t) <> t as caps from w),
h as (select doc_id, pos, line, case when length(t) <= 180 and (lv is not null or (caps and length(t) <= 120) or regexp_matches(low, '^(điều|khoản|mục|phần|chương)([^\\p{{L}}\\p{{N}}_]|$)')) then coalesce(lv, case when caps and length(t) <= 120 then 1 when regexp_matches(low, '^điều([^\\p{{L}}\\p{{N}}_]|$)') then 2 else 3 end) end as level from v),
k as (select *, last_value(case when level is not null then pos end ignore nulls) over (partition by doc_id order by pos) as node from h),
body as (select doc_id, node, min(pos) as pos, string_agg(line, chr(10) order by pos) as content from k where level is null group by all),
heads as (select doc_id, pos, level, line from h where level is not null),
up as (select b.doc_id, b.pos, list(a.line order by a.pos) as path from heads b join heads a on a.doc_id = b.doc_id and a.pos <= b.pos where a.pos = b.pos or not exists (select 1 from heads c where c.doc_id = a.doc_id and c.pos > a.pos and c.pos <= b.pos and c.level <= a.level) group by all)
select heads.doc_id, heads.pos::int as pos, level::int as level, path, coalesce(content, '') as content from heads join up on up.doc_id = heads.doc_id and up.pos = heads.pos left join body on body.doc_id = heads.doc_id and body.node = heads.pos
union all select doc_id, pos::int, 0, [], content from body where node is null"""
)
def document_outline(spark, d):
    return S.outline(_docs(spark, d))


@query(
    """with raw as (select doc_id, regexp_split_to_array(text, '\\r\\n|\\r|\\n') as ls from documents where text is not null), l as (select doc_id, unnest(generate_series(0, len(ls) - 1)) as pos, trim(unnest(ls), ' ') as line from raw)
select doc_id, pos, list_transform(string_split(regexp_replace(line, '^\\||\\|$', '', 'g'), '|'), lambda x: trim(x, ' ')) as cells from l where line[1] = '|' and length(line) > 1 and not regexp_matches(line, '^\\|?[\\s:|-]*-[\\s:|-]*\\|?$')"""
)
def table_cells(spark, d):
    return S.table_rows(_docs(spark, d))


@query(
    """with raw as (select doc_id, regexp_split_to_array(text, '\\r\\n|\\r|\\n') as ls from documents where text is not null), l as (select doc_id, unnest(generate_series(0, len(ls) - 1)) as pos, trim(unnest(ls), ' ') as line from raw),
c as (select doc_id, pos, list_transform(string_split(regexp_replace(line, '^\\||\\|$', '', 'g'), '|'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'), ' ')) as cells from l where line[1] = '|' and length(line) > 1 and not regexp_matches(line, '^\\|?[\\s:|-]*-[\\s:|-]*\\|?$'))
select doc_id, count(*) as rows, max(len(cells)) as columns from c group by 1 having count(*) >= 2"""
)
def tables_of_documents(spark, d):
    """Documents with a table of two rows and columns, rebuilt as Markdown and measured."""
    t = S.table_rows(_docs(spark, d)).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "cells"))).alias("l"))
    t = t.select("doc_id", F.transform("l", lambda x: x["cells"]).alias("r")).withColumn("md", S.to_markdown(F.col("r"))).where("md is not null")
    return t.select("doc_id", (F.size(F.split("md", "\n")) - 1).cast("bigint").alias("rows"), (F.size(F.split(F.substring_index("md", "\n", 1), r" \| "))).cast("bigint").alias("columns"))


@query("with k as (select sha256(text) as h, doc_id from documents where text is not null) select h as file_hash, min(doc_id) as doc_id, count(*) as copies from k group by 1 having count(*) > 1")
def exact_duplicates(spark, d):
    k = _docs(spark, d).where("text is not null").select(X.content_hash(F.col("text")).alias("file_hash"), "doc_id")
    return k.groupBy("file_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).where("copies > 1")


@query(
    """with a as (select doc_id, sha256(coalesce(text, '')) as h from documents where doc_id % 11 <> 0), b as (select doc_id, sha256(coalesce(text, '') || case when doc_id % 7 = 0 then ' ' else '' end) as h from documents where doc_id % 13 <> 0)
select doc_id, case when b.h is null then 'new' when a.h is null then 'delete' when a.h = b.h then 'skip' else 'update' end as action from a full join b using (doc_id)"""
)
def document_actions(spark, d):
    """The documents against an earlier state of them, made by a rule: some unknown, some changed, some gone."""
    x = _docs(spark, d).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    a = x.where("doc_id % 11 <> 0").select("doc_id", X.content_hash(F.col("text")).alias("file_hash"))
    b = x.where("doc_id % 13 <> 0").select("doc_id", X.content_hash(F.concat("text", F.when(F.col("doc_id") % 7 == 0, " ").otherwise(""))).alias("file_hash"))
    return X.actions(a, b)


@query("select count(*) as documents, coalesce(sum(chunk_count), 0) as chunks, count(*) filter (status = 'ready') as ready from document_catalog")
def catalog_stats(spark, d):
    return table(spark, d, "document_catalog").agg(F.count("*").alias("documents"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"), F.count_if(F.col("status") == "ready").alias("ready"))


@query("select id, original_name, coalesce(chunk_count, 0) as chunk_count, row_number() over (order by created_at desc nulls last, id) as place from document_catalog")
def newest_documents(spark, d):
    """All entries with their place from the newest; places run over days, so no task has to order all rows."""
    from vellum.operators.segments import positions

    c = table(spark, d, "document_catalog").withColumn("_o", -F.unix_micros(F.coalesce(F.col("created_at").cast("timestamp"), F.timestamp_seconds(F.lit(-(1 << 33))))))
    return positions(c.withColumn("_all", F.lit(1)), ["_all"], "_o", "place", 86400e6, ["id"]).select("id", "original_name", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), "place")


@query(
    """select id, lower(regexp_extract(filename, '\\.[^./\\\\]+$')) as ending, case lower(regexp_extract(filename, '\\.[^./\\\\]+$')) when '.pdf' then 'pdf' when '.doc' then 'word' when '.docx' then 'word' when '.xls' then 'sheet' when '.xlsx' then 'sheet' when '.csv' then 'sheet' when '.txt' then 'text' when '.md' then 'text' else 'other' end as kind,
 regexp_replace(regexp_replace(filename, '.*/', ''), '\\.[^.]*$', '') as stem, lower(replace(replace(replace(filename, ' ', ''), '_', ''), '-', '')) as name_key from document_catalog"""
)
def file_names(spark, d):
    n = F.col("filename")
    return table(spark, d, "document_catalog").select("id", T.file_ending(n).alias("ending"), T.file_kind(n).alias("kind"), T.file_stem(n).alias("stem"), T.name_key(n).alias("name_key"))


@query("select distinct doc_name as name from chunks where doc_name is not null and lower(doc_name) not in (select lower(filename) from document_catalog where filename is not null) and lower(regexp_replace(doc_name, '\\.[^.]*$', '')) not in (select lower(regexp_replace(filename, '\\.[^.]*$', '')) from document_catalog where filename is not null)")
def catalog_missing(spark, d):
    f = table(spark, d, "chunks").select(F.col("doc_name").alias("name")).where("name is not null").distinct()
    return X.missing_in_catalog(f, table(spark, d, "document_catalog"))


@query(
    """with n as (select distinct doc_name as name, lower(replace(replace(replace(doc_name, ' ', ''), '_', ''), '-', '')) as k, lower(replace(replace(replace(regexp_replace(doc_name, '\\.[^.]*$', ''), ' ', ''), '_', ''), '-', '')) as s from chunks where doc_name is not null),
c as (select id, created_at, lower(replace(replace(replace(filename, ' ', ''), '_', ''), '-', '')) as f, lower(replace(replace(replace(original_name, ' ', ''), '_', ''), '-', '')) as o, lower(replace(replace(replace(regexp_replace(original_name, '\\.[^.]*$', ''), ' ', ''), '_', ''), '-', '')) as os from document_catalog),
a as (select name, id, created_at, 1 as tier from n join c on k = f union all select name, id, created_at, 2 from n join c on k = o union all select name, id, created_at, 3 from n join c on s = os)
select name, id, tier from (select *, row_number() over (partition by name order by tier, coalesce(epoch_us(created_at), 0) desc, id) as r from a) where r = 1"""
)
def resolved_names(spark, d):
    return X.resolve(table(spark, d, "chunks").select(F.col("doc_name").alias("name")), table(spark, d, "document_catalog"))


@query("select c.id, count(k.id) as chunks, coalesce(sum(length(k.content)), 0) as characters, count(*) filter (k.is_table) as tables from document_catalog c left join chunks k on k.doc_id = c.id group by 1")
def chunks_per_document(spark, d):
    k = table(spark, d, "chunks").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("characters"), F.count_if("is_table").alias("tables"))
    j = table(spark, d, "document_catalog").select("id").join(k, F.col("id") == F.col("doc_id"), "left")
    return j.select("id", F.coalesce("n", F.lit(0)).alias("chunks"), F.coalesce("characters", F.lit(0)).alias("characters"), F.coalesce("tables", F.lit(0)).alias("tables"))


@query("with n as (select doc_id, unnest(list_distinct(list_transform(regexp_extract_all(lower(text), '(?:^|[^\\p{L}\\p{N}_])(?:điều|dieu)\\s+(\\d+)', 1), lambda x: x::int))) as n from documents where text is not null) select doc_id, list_sort(list(n)) as articles from n group by 1")
def cited_articles(spark, d):
    return _docs(spark, d).where("text is not null").select("doc_id", T.articles(F.lower("text")).alias("articles")).where("size(articles) > 0")


@query(
    "select doc_id, trim(regexp_replace(regexp_replace(lower(replace(replace(strip_accents(coalesce(title, '')), 'đ', 'd'), 'Đ', 'D')), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) as key from documents"
)
def title_keys(spark, d):
    return _docs(spark, d).select("doc_id", T.plain_key(F.col("title")).alias("key"))


@query("select doc_kind, count(*) as n, count(*) filter (text is null) as without_text, sum(n_chars) as characters, max(n_chars) as longest from documents group by 1")
def documents_by_kind(spark, d):
    return _docs(spark, d).groupBy("doc_kind").agg(F.count("*").alias("n"), F.count_if(F.col("text").isNull()).alias("without_text"), F.sum("n_chars").alias("characters"), F.max("n_chars").alias("longest"))


@query("with p as (select id, unnest(pages) as page from chunks) select page, count(distinct id) as chunks from p where page is not null group by 1")
def chunks_by_page(spark, d):
    return table(spark, d, "chunks").select("id", F.explode("pages").alias("page")).where("page is not null").groupBy("page").agg(F.count_distinct("id").alias("chunks"))


@query("select file_hash, count(distinct doc_id) as documents, count(*) as chunks from chunks group by 1")
def chunks_by_file(spark, d):
    return table(spark, d, "chunks").groupBy("file_hash").agg(F.count_distinct("doc_id").alias("documents"), F.count("*").alias("chunks"))


@query()
def expanded_questions(spark, d):
    """Questions of the store with their abbreviations written out."""
    return table(spark, d, "semantic_cache").select("entry_id", T.expand(F.col("query")).alias("query"))


@query()
def answer_tables(spark, d):
    """Answers whose lines are all pairs, as tables."""
    a = table(spark, d, "semantic_cache").select("entry_id", S.pairs_table(F.col("answer")).alias("answer"))
    return a.where("answer is not null")


@query(
    _LINES
    + f""", s as (select *, regexp_replace(line, '[\\s\\x{{00a0}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{3000}}]+', ' ', 'g') as t, pos // 10 + 1 as page from n), w as (select *, lower(t) as low from s), v as (select *, {_LEVEL} as lv, regexp_matches(t, '\\p{{L}}') and upper(t) = t and lower(t) <> t as caps from w),
h as (select doc_id, pos, t as line, page, case when length(t) <= 180 and (lv is not null or (caps and length(t) <= 120) or regexp_matches(low, '^(điều|khoản|mục|phần|chương)([^\\p{{L}}\\p{{N}}_]|$)')) then coalesce(lv, case when caps and length(t) <= 120 then 1 when regexp_matches(low, '^điều([^\\p{{L}}\\p{{N}}_]|$)') then 2 else 3 end) end as level from v),
k as (select *, last_value(case when level is not null then pos end ignore nulls) over (partition by doc_id order by pos) as node from h)
select doc_id as doc, min(pos)::int as pos, coalesce(max(level), 0)::int as level, coalesce(string_agg(line, chr(10) || chr(10) order by pos) filter (level is null), '') as content, list_sort(list_distinct(list(page::int))) as pages from k group by doc_id, node"""
)
def element_tree(spark, d):
    """Documents as elements, ten lines a page, put into their heading trees with pages."""
    e = S.lines(_docs(spark, d)).select(F.col("doc_id").alias("doc"), "pos", F.col("line").alias("text"), F.lit("Text").alias("category"), (F.floor(F.col("pos") / 10) + 1).alias("page"))
    return S.element_outline(e).select("doc", "pos", "level", "content", "pages")


@query()
def element_chunks(spark, d):
    """The trees of element_tree packed into chunks with their pages."""
    e = S.lines(_docs(spark, d)).select(F.col("doc_id").alias("doc"), "pos", F.col("line").alias("text"), F.lit("Text").alias("category"), (F.floor(F.col("pos") / 10) + 1).alias("page"))
    return S.element_chunks(e)


@query("select doc_id as title_id, string_agg(content, chr(10) order by id) as content, coalesce(list_sort(list_distinct(list(pages[1]) filter (pages[1] > 0))), []) as pages from chunks where doc_id is not null and trim(content, ' ') <> '' group by 1")
def titled_chunks(spark, d):
    """Chunks put together by their document, with the first page of each."""
    c = table(spark, d, "chunks").select(F.col("doc_id").alias("title_id"), F.col("id").alias("pos"), F.col("content").alias("text"), F.try_element_at("pages", F.lit(1)).alias("page"))
    return S.by_title(c)


@query("select c.id as title_id, coalesce(k.content, c.original_name) as content from document_catalog c left join (select doc_id, string_agg(content, chr(10) order by id) as content from chunks where doc_id is not null and trim(content, ' ') <> '' group by 1) k on k.doc_id = c.id")
def filled_catalog(spark, d):
    """Catalog entries with the text of their chunks; those without chunks keep their name."""
    n = table(spark, d, "document_catalog").select(F.col("id").alias("title_id"), F.col("original_name").alias("content"), F.array().cast("array<int>").alias("pages"))
    return S.filled(n, titled_chunks(spark, d)).select("title_id", "content")


@query()
def question_tokens(spark, d):
    """Tokens of the store's questions by a public vocabulary."""
    from vellum.operators import models

    return table(spark, d, "semantic_cache").select("entry_id", models.counted(F.col("query")).alias("tokens"))


@query("select id, greatest(1, coalesce(try_cast(case when file_size % 3 = 0 then 'x' else (file_size % 7 - 2)::varchar end as int), 1)) as page from document_catalog")
def safe_pages(spark, d):
    """Page numbers as files give them, some of them none."""
    n = F.when(F.col("file_size") % 3 == 0, "x").otherwise((F.col("file_size") % 7 - 2).cast("string"))
    return table(spark, d, "document_catalog").select("id", S.page_number(n).alias("page"))
