"""The same results in SQL, where SQL can say them."""

from __future__ import annotations

#: White space and characters without ink, as the operators trim them.
_EDGE = r"[\s\x{00a0}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{206f}\x{3000}\x{feff}\x{00ad}]"

P1 = rf"""
with m as (select any_value(session_id) as s, id, any_value(role) as r, any_value(content) as c, any_value(created_at) as ts from chat_messages group by id),
n as (select lower(regexp_replace(s, '^{_EDGE}+|{_EDGE}+$', '', 'g')) as sid, id, lower(regexp_replace(r, '^{_EDGE}+|{_EDGE}+$', '', 'g')) as r, c, ts,
  length(regexp_replace(coalesce(c, ''), '{_EDGE}', '', 'g')) > 0 as vis from m),
k as (select sid, id, ts, c, case when r in ('user', 'human', 'student', 'customer', 'client', 'me', 'person') then 1 when r in ('model', 'assistant', 'bot', 'ai', 'chatbot', 'agent', 'gpt') then 2 else 0 end as who
  from n where sid <> '' and vis and coalesce(r, '') not in ('system', 'developer')),
l as (select *, lag(who) over w as pw, lag(c) over w as pc, lag(ts) over w as pa from k window w as (partition by sid order by ts nulls last, id)),
f as (select *, coalesce(who = pw and c = pc and ts - pa <= interval 5 second, false) as rep from l),
t as (select *, lag(who) over w as pw2, lead(who) over w as nw2 from f where not rep window w as (partition by sid order by ts nulls last, id)),
j as (select sid, max((ts is null or who = 0 or (pw2 is null and who = 2) or (pw2 = 2 and who = 2))::int) as br, max((who = 1 and coalesce(nw2, 1) <> 2)::int) as mr from t group by sid)
"""

P1_FOUND = (
    P1
    + """
select s.sid as session_id, case when j.sid is null then 'empty' when br = 1 then 'broken' else 'missing_reply' end as defect
from (select distinct sid from n where sid <> '') s left join j using (sid) where j.sid is null or br = 1 or mr = 1
"""
)

P1_TURNS = (
    P1
    + """
select sid as session_id, row_number() over (partition by sid order by ts, id) as turn, case who when 1 then 'user' else 'model' end as speaker, c as content, ts as created_at
from f where not rep and sid in (select sid from j where br = 0 and mr = 0)
"""
)

P2_FOUND = r"""
with t as (select id, regexp_replace(content, '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g') as c from chunks)
select id as chunk_id, case when max(list_max(list_transform(regexp_split_to_array(c, '[ \t\n\r\f]'), lambda x: length(x)))) > 1200 then 'forced' else 'natural' end as cut
from t where length(c) > 1200 group by id
"""



def _translate(text: str) -> str:
    """SQL for a text with look-alike letters, full-width forms and blanks mapped."""
    from vellum.llm.lookalikes import CYRILLIC, GREEK, OTHERS

    pairs = CYRILLIC | GREEK | {k: v for k, v in OTHERS.items() if len(v) == 1} | {chr(0xFEE0 + i): chr(i) for i in range(0x21, 0x7F)}
    pairs |= dict.fromkeys([chr(c) for c in (9, 0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)], " ")
    quote = lambda x: x.replace("'", "''")
    return f"translate({text}, '{quote(''.join(pairs))}', '{quote(''.join(pairs.values()))}')"


_P5 = rf"""
with t as (select 'semantic_cache.query' as field, entry_id::varchar as key, query as text from semantic_cache union all select 'document_catalog.original_name', id, original_name from document_catalog
  union all select 'chat_messages.content', id::varchar, content from (select distinct on (id) * from chat_messages)),
f as (select field, key, text, trim(regexp_replace(nfc_normalize({_translate("regexp_replace(text, '[" + chr(0xAD) + chr(0x200B) + "-" + chr(0x200F) + chr(0x2060) + "-" + chr(0x206F) + chr(0xFEFF) + "]', '', 'g')")}), ' +', ' ', 'g')) as form from t where text is not null)
"""
P5_FOUND = (
    _P5
    + """
select a.field, least(a.key, b.key) as key_a, greatest(a.key, b.key) as key_b from f a join f b on a.field = b.field and a.form = b.form and a.text < b.text where a.form <> ''
"""
)
P5_FORMS = (
    _P5
    + """, c as (select field, form, min(text) as first, count(distinct text) as ways, count(*) as records from f where form <> '' group by all having count(distinct text) > 1)
select field, key, first, ways, records from f join c using (field, form)
"""
)

#: Words as they are compared; texts without tags and entities, as in the test tables.
_WORDS = "regexp_extract_all(regexp_replace(strip_accents(replace(lower({}), 'đ', 'd')), '[\\p{{M}}\\x{{00ad}}\\x{{200b}}-\\x{{200f}}\\x{{2060}}-\\x{{2064}}\\x{{feff}}]', '', 'g'), '[\\p{{L}}\\p{{N}}]+')"
P7_FOUND = f"""
with d as (select doc_id, {_WORDS.format("text")} as w from documents where text is not null), p as (select item_id, {_WORDS.format("passage")} as w from eval_items where passage is not null),
dg as (select doc_id, array_to_string(w[i:i + 4], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from d)),
pg as (select item_id, i, array_to_string(w[i:i + 4], ' ') as g, len(w) as n from (select item_id, w, unnest(range(1, len(w) - 3)) as i from p)),
h as (select distinct doc_id, item_id, i, n from pg join dg using (g)),
c as (select doc_id, item_id, n, count(distinct i + k) as got from h, range(0, 5) r(k) group by all)
select doc_id, item_id from c where got >= n / 3
"""


P4_FOUND = """
with v as (select entry_id, vector from semantic_cache union all select entry_id, vector from cache_entries),
u as (select entry_id, vector::double[] as x from v where len(vector) = 64 and list_bool_and(list_transform(vector, lambda x: isfinite(x))) and list_max(list_transform(vector, lambda x: abs(x))) > 0),
w as (select entry_id, list_transform(x, lambda y: y / list_max(list_transform(x, lambda z: abs(z)))) as x from u),
c as (select a.entry_id as a, b.entry_id as b, array_cosine_similarity(a.x::double[64], b.x::double[64]) as s from w a join w b on a.entry_id <> b.entry_id),
t as (select a, b, s from c qualify row_number() over (partition by a order by round(s, 6) desc, b) <= 5)
select distinct least(a, b) as entry_a, greatest(a, b) as entry_b from t where s >= 0.85
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p1_turns": P1_TURNS, "p2_found": P2_FOUND, "p4_found": P4_FOUND, "p5_found": P5_FOUND, "p5_forms": P5_FORMS, "p7_found": P7_FOUND}
