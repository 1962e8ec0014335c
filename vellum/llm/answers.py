"""Answers that don't serve their question.

Each answer gets at most one defect, in this order: empty, refusal, copy, other_language,
truncated.

Shortened versions. The last sentences of all answers are brought to a form without case and
digits, and sorted as texts in ranges; in a sorted list whatever a text is cut from follows
directly after it, so one comparison of neighbours' common prefix tells whether an ending is
the start of a longer sentence. How sentences end is counted over all answers: for the last
words of an open ending, how often they close a sentence and how often they are followed by
another word. Only the first sentence of each range has to meet the last of the one before.

Length limits. Answers cut at a limit pile up at one length: lengths at which far more different
open endings stand than around them are spikes, and an open ending at a spike counts as cut.

Languages of query and answer are told by the model of `languages`, trained on labelled documents.

Everything is aggregated by distinct text before it is compared, so repeated answers cost
nothing. Defined results: a null answer is empty; a null query can only give empty, refusal or
truncated; repeated entries are judged once for each entry id; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import languages
from vellum.llm.text import fold

#: Fillers that stand for nothing, folded and without marks.
_FILLER = {"null", "none", "nil", "n/a", "na", "n.a", "nan", "undefined", "empty", "blank", "trong", "rong", "khong co", "chua co", "vide", "neant", "sans objet", "leer", "vacio", "vazio", "nada", "tbd", "todo", "no answer", "no data", "no content", "not available", "khong co du lieu", "khong co cau tra loi", "missing"}
_ME = r"\b(?:minh|toi|em|tro ly|he thong|chung toi|chung minh) (?:\w+ ){0,4}?"
_VERB = r"(?:tra loi|giai dap|tu van|ho tro|giup|cung cap|dap ung|thuc hien yeu cau|khang dinh|xac nhan|dua ra)"
_TOPIC = r"(?:about|on|for|regarding|concerning|of)"
#: Signs that the one who answers refuses or doesn't know, by language; what anybody may not do, or what is not available, is an answer. Folded, codes and numbers as 0.
OWN = re.compile(
    "|".join(
        (
            # Vietnamese
            _ME + r"(?:khong the|chua the|khong du kha nang|khong co kha nang|tu choi|xin phep khong|xin phep tu choi) (?:\w+ ){0,3}?" + _VERB,
            _ME + r"(?:(?:khong|chua) (?:co|tim thay|tim duoc|nam duoc|ghi nhan|thay) (?:\w+ ){0,3}?(?:thong tin|noi dung|du lieu|tai lieu|cau tra loi|ket qua)|khong duoc phep|khong biet|khong ro|chua ro|khong chac|khong dam|chua biet|khong hieu)",
            r"xin phep (?:khong|tu choi) " + _VERB + r"|(?:khong the|chua the|tu choi) (?:tra loi|giai dap)|khong dam khang dinh",
            r"(?:^|, |\b(?:xin loi|rat tiec|hien|hien tai|hien nay|tai lieu|du lieu|du lieu hien co) )(?:khong|chua) (?:co|tim thay|tim duoc|ghi nhan) (?:\w+ ){0,2}?(?:thong tin|du lieu|noi dung|tai lieu|cau tra loi) (?:\w+ ){0,3}?(?:ve|lien quan|cho|de cap)\b",
            r"(?:ngoai|khong thuoc|khong nam trong|chua thuoc) (?:pham vi|kha nang) (?:\w+ ){0,3}?(?:cua (?:minh|toi|em|tro ly|he thong|chung toi)|ma (?:minh|toi|em)|tra loi|giai dap)",
            # English
            r"\b(?:i|the assistant)(?:'m| am| is)? (?:\w+ ){0,3}?(?:unable|not able|not allowed|not permitted|not in a position)\b",
            r"\bi (?:\w+ ){0,2}?(?:can ?not|can't|could not|couldn't|won't|will not|must decline|do not know|don't know|have no|do not have|don't have|did not find|didn't find|found no|would rather (?:not|leave)|prefer not|refuse|decline|am not sure)\b|\bi'd (?:prefer not|rather (?:not|leave))\b",
            r"\bwe (?:\w+ ){0,3}?(?:unable to|not able to|can ?not|can't|could not|couldn't) (?:answer|help|assist|find|comment)\b|\bwe (?:have no|do not have|don't have|found no|did not find|didn't find) (?:\w+ )?(?:information|details|answer|data) " + _TOPIC,
            r"\b(?:outside|beyond|past|not within) (?:of )?(?:what i|my) (?:\w+ ){0,2}?(?:scope|can|able|support|remit|knowledge)|\b(?:says nothing|(?:there is|found) no information) " + _TOPIC,
            # French
            r"je (?:ne )?(?:\w+ ){0,2}?(?:peux|sais|suis|puis|trouve|dispose|connais)(?: malheureusement)? pas\b|je n'ai (?:\w+ )?(?:trouve|aucune|pas)|je (?:refuse|prefere ne pas)|(?:depasse|hors de|en dehors de) (?:ce que je|mon|mes)\b|aucune information (?:sur|concernant|a propos|au sujet)",
            # German
            r"\bich (?:kann|konnte|darf|mochte|weiss|habe|finde|bin) (?:\w+ ){0,5}?(?:nicht|keine|nichts)\b|\b(?:kann|darf|mochte|weiss|habe) ich (?:\w+ ){0,5}?(?:nicht|keine|nichts)\b|ausserhalb (?:meines|meiner)\b|liegen mir (?:\w+ )?keine|keine (?:informationen|angaben) (?:zu|zum|zur|uber)\b",
            # Spanish and Portuguese
            r"\bno (?:puedo|dispongo|tengo|encontre|he encontrado|hallo|encuentro|me es posible|estoy autorizad[oa])\b|\bno se (?:nada|cual|cuales|cuando|cuanto|cuanta|donde|como es|la respuesta)\b|\bfuera de (?:mi|mis|lo que puedo)\b|ninguna informacion (?:sobre|de|acerca)|prefiero no\b|me niego",
            r"\bnao (?:posso|sei|tenho|encontrei|disponho|consigo|estou autorizad[oa]|me e possivel)\b|\bfora (?:do|da|de) (?:meu|minha)\b|nenhuma informacao (?:sobre|de|acerca)|prefiro nao\b|recuso",
        )
    )
)
#: Where a clause may begin, and words by which a clause states something, folded.
_CLAUSE = re.compile(r"[,;:] |\b(?:but|however|tuy nhien|mais|cependant|aber|jedoch|pero|sin embargo|porem)\b")
_STATES = re.compile(r"\b(?:is|are|was|were|will|must|costs?|la|phai|gom|tu|den|truoc|het|est|sont|coute|ist|sind|kostet|betragt|es|son|cuesta|e|sao|custa)\b")
_NUMBER = re.compile(r"\b(?:[a-z]{1,6}-?)?\d\w*(?:[-/.,:]\w+)*")
_LABEL = re.compile(r"\b[a-z]{1,6}-?\d[\w-]*")
#: Sentences beside a refusal that give no answer: greetings, regrets, advice to ask elsewhere.
_SORRY = re.compile(
    r"^(?:chao|xin chao|da|alo|hello|hi|hey|dear|bonjour|salut|hallo|guten tag|hola|ola|buenos|bom dia|xin loi|rat tiec|thanh that|sorry|apolog|i'm sorry|i am sorry|unfortunately|regret|desole|malheureusement|pardon|leider|tut mir leid|entschuldig|lo siento|lamento|lamentablemente|sinto|desculpe|infelizmente)"
)
COURTESY = re.compile(
    _SORRY.pattern
    + r"|(?:vui long|hay|nen|mong ban|xin) (?:\w+ ){0,4}?(?:lien he|hoi|thong cam|truy cap|quay lai|den)|please (?:\w+ ){0,3}?(?:ask|contact|reach|visit|try|call|check|consult|speak|turn)|(?:veuillez|adressez|contactez)|(?:bitte wenden|wenden sie sich|bitte fragen)|(?:consulte|contacte|dirijase|dirija-se|pregunte|pergunte|por favor)"
)
#: Requests for a language, folded.
ASKED = re.compile(
    r"(?:tra loi|viet|noi|dich|giai thich|huong dan|answer|reply|respond|write|explain|translate|repon\w*|ecri\w*|traduis\w*|antwort\w*|schreib\w*|ubersetz\w*|respond\w*|contest\w*|escrib\w*|traduc\w*|escrev\w*|traduz\w*)(?: \w+){0,4}? (?:bang|sang|in|into|en|auf|ins|em|para o|al) (?:tieng |the |la |el |o )?"
    r"(?:anh|viet|phap|duc|tay ban nha|bo dao nha|english|vietnamese|french|german|spanish|portuguese|anglais|vietnamien|francais|allemand|espagnol|portugais|englisch\w*|vietnamesisch\w*|franzosisch\w*|deutsch\w*|spanisch\w*|portugiesisch\w*|ingles|vietnamita|frances|aleman|alemao|espanol|espanhol|portugues)\b"
    r"|^(?:in|en|auf|em) (?:english|vietnamese|french|german|spanish|portuguese|anglais|vietnamien|francais|allemand|espagnol|portugais|englisch|deutsch|ingles|espanol|espanhol|portugues)\b|\b(?:in english|en anglais|auf englisch|bang tieng anh|en ingles|em ingles|auf deutsch|en francais|em portugues|en espanol)(?: (?:please|s'il vous plait|bitte|por favor|nhe|giup \w+))?[ ?.!]*$"
)
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_MARK = re.compile(r"[*_`#>~|\"“”«»‘’()\[\]{}.…:;,!?\-–—•·\s​⁠﻿­]+")
#: Ends of sentences as the operator splits them: after a stop, or at a line break.
SENTENCE = r"(?<=[.!?…])[\"'”’»)\]*_]*\s+(?=[^\s])|[\r\n]+"


def shows(text: str | None) -> bool:
    """Whether anything readable is there: neither nothing, marks only, nor a filler."""
    if text is None:
        return False
    t = " ".join(_MARK.sub(" ", fold(text)).split())
    return bool(t) and t not in _FILLER and " ".join(fold(text).split()).strip("()[]{}<>*_`'\" .") not in _FILLER


def sentences(text: str) -> list[str]:
    return [s for s in (x.strip() for x in re.split(SENTENCE, text)) if s]


_HELLO = re.compile(r"^(?:chao ban|xin chao|da|hello|hi|hey|bonjour|salut|hallo|guten tag|hola|ola)\b[ ,!.:]*")


def _declines(s: str) -> bool:
    """Whether in a folded sentence the one who answers refuses, and no other clause states a number."""
    if not OWN.search(_NUMBER.sub("0", s)):
        return False
    own = False
    for c in _CLAUSE.split(s):
        if OWN.search(_NUMBER.sub("0", c.strip())):
            own = True
        elif _STATES.search(c) and re.search(r"\d", c if own else _LABEL.sub("", c)) and not COURTESY.search(c.strip()):
            return False  # codes before the refusal name what was asked
    return True


#: Characters up to which a sentence beside a refusal can be mere courtesy.
COURTESY_CHARS = 200


def refuses(text: str) -> bool:
    """Whether an answer declines or doesn't know, and says nothing else: a sentence that refuses, all others courtesy."""
    found = False
    for s in sentences(re.sub(r"\s+", " ", fold(text)).replace("’", "'")):
        s = _HELLO.sub("", s)
        if not _WORD.search(s):
            continue
        if _declines(s):
            found = True
        elif not COURTESY.search(s) or len(s) > COURTESY_CHARS or _SORRY.search(s) and re.search(r"\d", _LABEL.sub("", s)):
            return False
    return found


#: Words that name or greet without adding anything to a repeated question.
LEAD = {"q", "question", "frage", "pregunta", "pergunta", "cau", "hoi", "ban", "da", "hello", "hi", "bonjour", "hola", "ola", "hallo", "chao", "you", "asked", "query", "vous", "demandez", "a", "re"}


def copies(query: str, answer: str) -> bool:
    """Whether an answer is the query, once or more, with at most a lead such as `Question:`."""
    q, a = _WORD.findall(fold(query)), _WORD.findall(fold(answer))
    if not q or not a:
        return False
    i, used, rounds = 0, 0, 0
    while i < len(a):
        if a[i : i + len(q)] == q:
            i += len(q)
            rounds += 1
        elif a[i] in LEAD:
            i += 1
        else:
            break
    if rounds and i == len(a):
        return True
    core_q, core_a = [w for w in q if w not in LEAD], [w for w in a if w not in LEAD]
    return len(core_a) >= 3 and core_a == core_q[: len(core_a)] and len(core_a) >= 0.8 * len(core_q)


#: Letters under which a text has no language.
LETTERS = 8


def foreign(pairs: list[tuple[str, str]], model: languages.Model) -> list[bool]:
    """Of pairs of query and answer: whether both are rather in one language than in any other, these are more likely two than one, and the query doesn't ask for that."""
    out = [False] * len(pairs)
    ask = [k for k, (q, _) in enumerate(pairs) if not ASKED.search(" ".join(fold(q).replace(":", " ").split()))]
    words = [languages.words_of(pairs[k][i]) for i in (0, 1) for k in ask]
    said = model.scores(words)
    n = len(ask)
    known = (said.max(1) > np.log(0.5)) & np.array([sum(map(len, w)) >= LETTERS for w in words], bool)
    two = known[:n] & known[n:] & (np.exp(said[:n] + said[n:]).sum(1) < 0.5)
    for j, k in enumerate(ask):
        out[k] = bool(two[j])
    return out


def plain_defects(rows: list[tuple[str | None, str | None]], model: languages.Model) -> list[str | None]:
    """The defect that each row (query, answer) shows by itself; None leaves truncation open."""
    out = ["empty" if not shows(a) else "refusal" if refuses(a) else "copy" if q is not None and copies(q, a) else None for q, a in rows]
    open_ = [k for k, d in enumerate(out) if d is None and rows[k][0] is not None]
    for k, other in zip(open_, foreign([rows[k] for k in open_], model), strict=True):
        if other:
            out[k] = "other_language"
    return out


_OPEN = re.compile(r"(?:^|\n)\s*(?:\d{1,2}[.)]|[-*+•])\s*(?:\*\*?)?\s*$|[:;,(\[{=+/&–—-]\s*$|(?:^|\s)[\"“«]\s*$")
_PICTURE = re.compile("[\U0001f000-\U0001faff☀-➿️‍\\s]+$")
_CLOSED = re.compile(r"[.!?…。！？][\"'”’»)\]*_]*$")


def ending(text: str) -> tuple[str, bool]:
    """(state, last sentence): state is closed, cut (an open block, list or bracket) or open; the sentence is folded, digits as 0."""
    t = _PICTURE.sub("", text.rstrip())
    pictured = t != text.rstrip()
    last = re.split(SENTENCE, t.rstrip())[-1].strip()
    if t.count("```") % 2 or t.count("**") % 2 or _OPEN.search(t):
        return "cut", last
    if _CLOSED.search(t) and t.count("(") <= t.count(")"):
        return "closed", last
    if t.count("(") > t.count(")"):
        return "cut", last
    if pictured or re.search(r"(?:[\w.+-]+@[\w-]+\.[\w.-]+|(?:https?://|www\.)?\w[\w-]*(?:\.\w[\w-]*)+/[\w/.-]+|\d{3,}-\d{3,})$", t):
        return "closed", last
    return "open", last


def masked(s: str) -> str:
    """A sentence for comparison: folded, numbers as 0, without marks at its ends."""
    s = re.sub(r"\d+", "0", fold(s)).strip()
    s = re.sub(r"^(?:[-*+•]|0[.)])\s+", "", s)
    return re.sub(r"\s+", " ", s).strip(" *_`\"'“”«»)(.!?…")


PASS = "entry_id bigint, defect string, state string, last string, size int, sentence string, done boolean, n bigint"
_COLS = [c.split()[0] for c in PASS.split(", ")]


def _read(sent):
    """One pass over the answers: a row for each entry, and one for each distinct sentence of a batch with how often it was seen and whether closed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value
        for f in frames:
            out, seen = [], {}
            rows = list(zip(f["query"], f["answer"], strict=True))
            for e, (_, a), d in zip(f["entry_id"], rows, plain_defects(rows, model), strict=True):
                state, last = ("", "") if d else ending(a)
                out.append((e, d, state, masked(last) if state == "open" else None, len(a) if a else 0, None, None, None))
                if d:
                    continue
                parts = sentences(a)
                for k, s in enumerate(parts):
                    done = bool(_CLOSED.search(s)) and s.count("(") <= s.count(")")
                    if done or k < len(parts) - 1:  # whether an open last one is complete is the question
                        m = masked(s)
                        if m:
                            seen[m, done] = seen.get((m, done), 0) + 1
            yield pd.DataFrame(out + [(None, None, None, None, None, m, done, n) for (m, done), n in seen.items()], columns=_COLS).astype({"entry_id": "Int64", "size": "Int32", "n": "Int64", "done": "boolean"})

    return run


def _neighbours(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a sorted range: for each open ending whether the next text continues it (null if the range ended first), and the first text."""
    from pyspark import TaskContext

    part, held, first = TaskContext.get().partitionId(), None, True
    for f in frames:
        out = []
        for s, asks in zip(f["sentence"], f["asks"], strict=True):
            if first:
                out.append((part, s, None, True))
                first = False
            if held is not None:
                out.append((part, held, s.startswith(held), False))
            held = s if asks else None
        yield pd.DataFrame(out, columns=["part", "text", "longer", "first"]).astype({"longer": "boolean"})
    if held is not None:
        yield pd.DataFrame([(part, held, None, False)], columns=["part", "text", "longer", "first"]).astype({"longer": "boolean"})


def shortened(texts: DataFrame) -> DataFrame:
    """(last, longer) of the asking rows of texts (sentence, asks): whether another text goes on where they end."""
    from vellum.session import checkpointed

    got = checkpointed(texts.repartitionByRange("sentence").sortWithinPartitions("sentence").mapInPandas(_neighbours, "part int, text string, longer boolean, first boolean"))
    firsts = sorted((r.part, r.text) for r in got.where("first").select("part", "text").collect())  # one a task
    ends = [(r.text, any(t.startswith(r.text) for p, t in firsts if p > r.part)) for r in got.where("not first and longer is null").select("part", "text").collect()]  # at most one a task
    rest = texts.sparkSession.createDataFrame(ends, "last string, longer boolean")
    return got.where("not first and longer is not null").select(F.col("text").alias("last"), "longer").unionByName(rest)


def spikes(sizes: DataFrame, reach: int = 6, times: float = 8.0, evidence: float = 20.0) -> DataFrame:
    """Lengths (size) that are far more frequent than those around them: `times` as many, and too many for chance by a likelihood ratio of exp(evidence), with half a row as the least that is usual. sizes has size and n."""
    near = sizes.select(F.explode(F.array(*(F.col("size") + k for k in range(-reach, reach + 1) if k))).alias("size"), F.col("n").alias("m"))
    near = near.groupBy("size").agg((F.sum("m") / (2 * reach)).alias("usual"))
    usual = F.greatest(F.coalesce("usual", F.lit(0.0)), F.lit(0.5))
    ratio = F.col("n") * F.log(F.col("n") / usual) - F.col("n") + usual
    return sizes.join(near, "size", "left").where((F.col("n") > times * usual) & (ratio > evidence)).select("size")


def _grams(told: DataFrame) -> DataFrame:
    """(gram, ends, goes): how often one or two words close a sentence, and how often a word follows."""
    w = "split(sentence, ' ')"
    one = f"transform(sequence(1, size(w)), i -> struct(xxhash64(w[i - 1]) as gram, i = size(w) as at_end))"
    two = f"if(size(w) > 1, transform(sequence(2, size(w)), i -> struct(xxhash64(w[i - 2], w[i - 1]) as gram, i = size(w) as at_end)), array())"
    g = told.select(F.expr(w).alias("w"), "done", "n").select("done", "n", F.expr(f"inline(concat({one}, {two}))"))
    return g.groupBy("gram").agg(F.sum(F.when(F.col("at_end") & F.col("done"), F.col("n")).otherwise(0)).alias("ends"), F.sum(F.when(~F.col("at_end"), F.col("n")).otherwise(0)).alias("goes"))


def defects(cache: DataFrame, model: languages.Model) -> DataFrame:
    """(entry_id, defect) of every entry of cache (entry_id, query, answer) whose answer has one; languages are told by a trained model."""
    from vellum.session import checkpointed, spread

    rows = spread(cache.select(F.col("entry_id").cast("bigint"), "query", "answer"), "entry_id").where("entry_id is not null")
    seen = checkpointed(rows.mapInPandas(_read(cache.sparkSession.sparkContext.broadcast(model)), PASS))
    judged = seen.where("entry_id is not null")
    told = seen.where("sentence is not null").groupBy("sentence", "done").agg(F.sum("n").alias("n"))
    told = checkpointed(told)
    asked = judged.where("state = 'open'").groupBy(F.col("last")).agg(F.count("*").alias("times"))
    texts = told.select("sentence", F.lit(False).alias("asks")).unionByName(asked.select(F.col("last").alias("sentence"), F.lit(True).alias("asks"))).groupBy("sentence").agg(F.max("asks").alias("asks"))
    longer = shortened(texts)
    closed = told.where("done").select(F.col("sentence").alias("last"), F.lit(True).alias("closed")).distinct()
    g = _grams(told)
    w = F.split("last", " ")
    a = asked.select("last", F.xxhash64(F.element_at(w, -1)).alias("g1"), F.when(F.size(w) > 1, F.xxhash64(F.element_at(w, -2), F.element_at(w, -1))).alias("g2"))
    a = a.join(closed, "last", "left").join(longer, "last", "left")
    a = a.join(g.select(F.col("gram").alias("g2"), F.col("ends").alias("e2"), F.col("goes").alias("c2")), "g2", "left").join(g.select(F.col("gram").alias("g1"), F.col("ends").alias("e1"), F.col("goes").alias("c1")), "g1", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    by_two = n("e2") >= 0.1 * n("c2")
    by_one = (n("e1") > 0) & (n("e1") >= 0.1 * n("c1"))
    whole = F.when(F.col("closed"), True).when(F.col("longer"), False).when(n("e2") + n("c2") > 0, (n("e2") > 0) & by_two).otherwise(by_one)
    a = a.select("last", whole.alias("whole"), F.coalesce("closed", F.lit(False)).alias("closed"))
    high = spikes(judged.where("state = 'open'").groupBy("size").agg(F.count_distinct("last").alias("n"))).withColumn("high", F.lit(True))  # stock endings count once
    j = judged.select("entry_id", "defect", "state", "last", "size").join(a, "last", "left").join(high, "size", "left")
    cut = (F.col("state") == "cut") | ((F.col("state") == "open") & (~F.col("whole") | (F.coalesce("high", F.lit(False)) & ~F.col("closed"))))
    return j.select("entry_id", F.coalesce("defect", F.when(cut, "truncated")).alias("defect")).where("defect is not null").distinct()
