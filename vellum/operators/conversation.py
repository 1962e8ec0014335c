"""Analytics of conversations: histories, questions before answers, follow-ups, feedback, exports.

Messages are (id, session_id, role, content, source_docs, created_at); rows stored more than
once under an id count once. Order is always (created_at, id) or id, never insertion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import segments

USER = ["user", "human"]
MODEL = ["model", "assistant", "bot"]
# How a question refers to the answer before it, as plain keys: parts that are counted, ordinals, parts that may be `above`, what `that` may follow, whole phrases.
PARTS = ["y", "muc", "dong", "khoan", "dieu", "truong hop"]
ORDINALS = ["dau tien", "thu nhat", "thu hai", "thu ba", "thu tu"]
ABOVE = {"tren": ["y", "muc", "dong"], "phia tren": ["y"]}
THAT = ["cai", "noi dung", "phan"]
MORE = ["them", "ro hon", "cu the hon", "chi tiet hon"]
PHRASES = ["do la gi", "no la gi", "no co nghia", "ve dieu nay", "ve viec nay"]


def messages(df: DataFrame) -> DataFrame:
    """Distinct messages with `who` (user, model or null) and `sid`, the session id without case and outer blanks."""
    r = F.lower(F.trim("role"))
    who = F.when(r.isin(USER), "user").when(r.isin(MODEL), "model")
    sid = F.lower(F.trim("session_id"))
    return df.dropDuplicates(["id"]).withColumn("who", who).withColumn("sid", F.when(sid != "", sid))


def question_before(m: DataFrame, width: float = segments.WIDTH) -> DataFrame:
    """(id, sid, question) of each model message: the latest user message with a smaller id in its session, as an as-of join."""
    q = segments.last_before(m.where("sid is not null").select("id", "sid", "who", "content"), ["sid"], "id", F.when(F.col("who") == "user", F.col("content")), "question", width)
    return q.where("who = 'model'").select("id", "sid", "question")


def recent(m: DataFrame, n: int = 30) -> DataFrame:
    """The newest n messages of each session with their place from the oldest kept; at most n of a session leave each task."""
    w = Window.partitionBy("sid").orderBy(F.desc_nulls_last("created_at"), F.desc("id"))
    r = m.where("sid is not null").withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)
    return r.withColumn("place", F.row_number().over(Window.partitionBy("sid").orderBy(F.desc("back"))))


def trim_history(m: DataFrame, budget: int = 4000, head: int = 2) -> DataFrame:
    """(sid, id): all of a session within the budget of estimated tokens, else its first `head` messages and the longest run of latest ones that fits beside them.

    A message costs at least one token, so no more than `budget` latest rows of a session can
    count; row limits on the window keep larger sessions from gathering in a task.
    """
    t = m.where("sid is not null").select("sid", "id", T.estimated_tokens(F.col("content")).alias("cost"))
    first = t.withColumn("n", F.row_number().over(Window.partitionBy("sid").orderBy("id"))).where(F.col("n") <= head)
    total = t.groupBy("sid").agg(F.sum("cost").alias("total"))
    start = first.groupBy("sid").agg(F.sum("cost").alias("start"), F.max("id").alias("edge"))
    back = Window.partitionBy("sid").orderBy(F.desc("id"))
    late = t.withColumn("n", F.row_number().over(back)).where(F.col("n") <= budget).withColumn("run", F.sum("cost").over(back))
    s = total.join(start, "sid")
    keep = late.join(s, "sid").where((F.col("total") <= budget) | ((F.col("id") > F.col("edge")) & (F.col("run") <= F.lit(budget) - F.col("start"))))
    return first.select("sid", "id").unionByName(keep.select("sid", "id")).distinct()


def last_said(m: DataFrame, who: str) -> DataFrame:
    """(sid, content): the last message of one speaker that isn't blank; an aggregate, not a window."""
    x = m.where((F.col("who") == who) & (T.squeeze(F.col("content")) != "") & F.col("sid").isNotNull())
    return x.groupBy("sid").agg(F.max_by("content", F.struct("created_at", "id")).alias("content"))


def refers_back(c: Column) -> Column:
    """Whether a question refers to the answer before it: to a counted part of it, to something above, or to it as a whole."""
    phrases = [*(f"y {o}" for o in ORDINALS), *(f"{n} {place}" for place, names in ABOVE.items() for n in names), *(f"{n} do" for n in THAT), *(f"giai thich {m}" for m in MORE), *PHRASES]
    key = F.concat(F.lit(" "), T.plain_key(c), F.lit(" "))
    return T.contains_any(key, [f" {p} " for p in phrases]) | key.rlike(rf" (?:{'|'.join(PARTS)}) (?:so )?\d+ ")


def rewritten(question: Column, answer: Column, before: Column, most: int = 400) -> Column:
    """A question that refers back, with what it refers to; other questions as they are."""
    cut = F.substring(T.squeeze(answer), 1, most)
    a, b = F.coalesce(F.trim(answer), F.lit("")) != "", F.coalesce(F.trim(before), F.lit("")) != ""
    full = F.concat(F.lit("Question: "), question, F.lit("\nEarlier question: "), before, F.lit("\nEarlier answer: "), cut)
    only_a = F.concat(F.lit("Question: "), question, F.lit("\nEarlier answer: "), cut)
    only_b = F.concat(F.lit("Question: "), question, F.lit("\nEarlier question: "), before)
    return F.when(~refers_back(question), question).when(a & b, full).when(a, only_a).when(b, only_b).otherwise(question)


def source_list(c: Column) -> Column:
    """Sources of a message: a JSON list, the list under `sources` of a JSON object, or an older form parted by bars; broken JSON and null give an empty list."""
    j = F.trim(c)
    as_list = F.from_json(F.when(j.startswith("["), j), "array<string>")
    as_object = F.from_json(F.when(j.startswith("{"), j), "struct<sources:array<string>>")["sources"]
    old = F.when(~j.rlike(r"^[\[{]"), F.transform(F.split(j, r"\|"), lambda x: F.trim(x)))
    got = F.coalesce(as_list, as_object, old, F.array().cast("array<string>"))
    return F.filter(got, lambda x: x.isNotNull() & (F.trim(x) != ""))


def pack_meta(sources: Column, images: Column, kind: Column) -> Column:
    """A JSON object of what is there; null when nothing is."""
    s = F.to_json(F.struct(F.when(F.size(sources) > 0, sources).alias("sources"), F.when(F.size(images) > 0, images).alias("images"), F.when(kind != "", kind).alias("kind")))
    return F.when(s != "{}", s)


def session_sizes(sessions: DataFrame, m: DataFrame) -> DataFrame:
    """Every session with the number of its messages, 0 included; counted before the join."""
    n = m.where("sid is not null").groupBy("sid").agg(F.count("*").alias("messages"))
    return sessions.select("id", "user_id", F.lower(F.trim("id")).alias("sid")).join(n, "sid", "left").select("id", "user_id", F.coalesce("messages", F.lit(0)).alias("messages"))


def transcript_pages(m: DataFrame, page: int = 200, width: float = segments.WIDTH) -> DataFrame:
    """(sid, page, text): sessions as Markdown, at most `page` messages a row, times at +07:00."""
    d = segments.positions(m.where("sid is not null and who is not null").select("sid", "id", "who", "content", "created_at"), ["sid"], "id", "n", width)
    when = F.date_format(F.col("created_at").cast("timestamp") + F.expr("interval 7 hours"), "dd/MM/yyyy HH:mm")
    line = F.concat(F.lit("**"), F.when(F.col("who") == "user", "User").otherwise("Assistant"), F.lit("** ("), F.coalesce(when, F.lit("-")), F.lit(")\n"), F.coalesce("content", F.lit("")))
    g = d.select("sid", F.floor((F.col("n") - 1) / page).alias("page"), "n", line.alias("line")).groupBy("sid", "page").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("l"))
    return g.select("sid", "page", F.array_join(F.transform("l", lambda x: x["line"]), "\n\n").alias("text"))


def latest_ratings(feedback: DataFrame) -> DataFrame:
    """One rating per message: the latest; ratings in one letter case."""
    f = feedback.where("message_id is not null")
    g = f.groupBy("message_id").agg(F.max_by(F.struct("id", F.lower(F.trim("rating")).alias("rating"), "comment_text", "created_at"), F.struct("created_at", "id")).alias("x"))
    return g.select("message_id", "x.*")


def feedback_by_day(feedback: DataFrame, since=None, until=None) -> DataFrame:
    """(day, like, dislike) with a row of zeros for every day without feedback between the first and the last."""
    f = feedback.select(F.to_date("created_at").alias("day"), F.lower(F.trim("rating")).alias("rating")).where("day is not null")
    if since is not None:
        f = f.where(F.col("day") >= since)
    if until is not None:
        f = f.where(F.col("day") <= until)
    g = f.groupBy("day").agg(F.count_if(F.col("rating") == "like").alias("like"), F.count_if(F.col("rating") == "dislike").alias("dislike"))
    days = g.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("day"))
    return days.join(g, "day", "left").select("day", F.coalesce("like", F.lit(0)).alias("like"), F.coalesce("dislike", F.lit(0)).alias("dislike"))


def recency(ts: Column, now: Column) -> Column:
    """today, week or older; null counts as today."""
    day = F.to_date(now)
    return F.when(ts.isNull() | (F.to_date(ts) >= day), "today").when(F.to_date(ts) >= F.date_sub(day, 6), "week").otherwise("older")


def without_session(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rows whose session isn't deleted."""
    return rows.join(sessions.select("session_id"), "session_id", "left_anti")


def delete_sessions(sessions: DataFrame, m: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sessions, messages) without the sessions named (id), whatever the case of their ids; feedback is left as it is."""
    g = gone.select(F.lower(F.trim("id")).alias("sid")).distinct()
    s = sessions.withColumn("sid", F.lower(F.trim("id"))).join(g, "sid", "left_anti").drop("sid")
    return s.select(*sessions.columns), m.join(g, "sid", "left_anti").select(*m.columns)


def renamed(sessions: DataFrame, changes: DataFrame, most: int = 100) -> DataFrame:
    """Sessions with the titles of changes (id, title, at): trimmed, at most `most` characters; blank ones change nothing, the latest of a session counts."""
    c = changes.withColumn("title", F.substring(T.squeeze(F.col("title")), 1, most)).where("title <> ''").groupBy("id").agg(F.max_by("title", F.struct("at", "title")).alias("_title"), F.max("at").alias("_at"))
    j = sessions.join(c, "id", "left").withColumns({"title": F.coalesce("_title", "title"), "updated_at": F.greatest("updated_at", "_at")})
    return j.select(*sessions.columns)


def reassigned(sessions: DataFrame, owner: str, to: str) -> DataFrame:
    """Sessions of one owner given to another."""
    return sessions.withColumn("user_id", F.when(F.col("user_id") == owner, to).otherwise(F.col("user_id")))


def owned_by(sessions: DataFrame, user: Column) -> DataFrame:
    """Sessions that a user may see; a session without an owner is nobody's."""
    return sessions.where(F.coalesce(F.col("user_id") == user, F.lit(False)))


def last_image(m: DataFrame) -> DataFrame:
    """(sid, id, images): the newest message of each session whose JSON meta is of kind user_image and names images; an aggregate, so a session of any size is reduced in every task."""
    j = F.when(F.trim("source_docs").startswith("{"), F.from_json("source_docs", "struct<kind:string,images:array<string>>"))
    x = m.where("sid is not null").withColumn("_j", j).where((F.col("_j.kind") == "user_image") & (F.size("_j.images") > 0))
    return x.groupBy("sid").agg(F.max_by(F.struct("id", F.col("_j.images").alias("images")), F.struct("created_at", "id")).alias("x")).select("sid", "x.*")


def utc(ts: Column) -> Column:
    """A time without zone, which means UTC, in ISO 8601."""
    return F.date_format(ts.cast("timestamp_ntz").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def clean_title(c: Column, most: int = 80) -> Column:
    """A title a model gave, without quotes and stops at its ends; null if nothing or more than `most` characters are left."""
    t = F.regexp_replace(T.squeeze(c), r"^[\s\"'“”‘’.]+|[\s\"'“”‘’.]+$", "")
    return F.when((t != "") & (F.length(t) <= most), t)
