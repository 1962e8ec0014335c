"""What users say of themselves: facts taken from messages by rules, the latest of each kind kept, and a prompt made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as T

#: Names of subjects by how they are said; the first that occurs counts.
SUBJECTS = [("công nghệ thông tin", "Công nghệ thông tin"), ("cntt", "Công nghệ thông tin"), ("kỹ thuật phần mềm", "Kỹ thuật phần mềm"), ("ktpm", "Kỹ thuật phần mềm"), ("hệ thống thông tin", "Hệ thống thông tin"), ("quản trị kinh doanh", "Quản trị kinh doanh"), ("qtkd", "Quản trị kinh doanh"), ("kế toán", "Kế toán"), ("kinh tế xây dựng", "Kinh tế xây dựng"), ("tài chính ngân hàng", "Tài chính ngân hàng"), ("logistics", "Logistics")]
LABELS = {"cohort": "Khóa", "subject": "Ngành", "target": "Mục tiêu điểm", "retake": "Môn cần cải thiện"}


def profile(c: Column, subjects: list[tuple[str, str]] | None = None) -> Column:
    """Map of cohort, subject, target and retake found in a message; without what isn't there."""
    low = F.lower(F.coalesce(c, F.lit("")))
    got = lambda p: F.regexp_extract(low, p, 1)
    some = lambda x: F.when(x != "", x)
    cohort = some(got(r"(?U)\b(?:k|khóa|khoá)\s*(\d{2})\b"))
    said = F.concat_ws(" ", got(r"(?U)\b(?:ngành|chuyên ngành)\s+([\p{L}\s]+?)(?:,|\.|\n|$|\bkhoa|\blớp)"), got(r"(?U)\bhọc\s+([\p{L} ]+)"))
    subject = F.lit(None).cast("string")
    for name, full in reversed(SUBJECTS if subjects is None else subjects):
        subject = F.when(said.rlike(rf"(?U)\b{name}\b"), full).otherwise(subject)
    target = some(got(r"(?U)\b(?:mục tiêu|target|cần|muốn)\s*(?:cpa|gpa|điểm)\s*(?:là|khoảng|đạt)?\s*([1-4](?:\.\d{1,2})?)\b"))
    retake = some(F.initcap(F.trim(got(r"(?U)\b(?:nợ môn|học lại môn|thi lại môn|trượt môn)\s+([\p{L}0-9\s]+?)(?:,|\.|\n|$|\bcần|\bđể|\bvới)"))))
    m = F.map_from_arrays(F.array(*map(F.lit, LABELS)), F.array(F.concat(F.lit("K"), cohort), subject, target, retake))
    return F.map_filter(m, lambda _, v: v.isNotNull())


def remembered(messages: DataFrame, known: DataFrame | None = None, nobody: str = "default_user") -> DataFrame:
    """(user_id, key, value, updated_at): the latest value of each kind, from messages (user_id, content, created_at, id) and what was known."""
    m = messages.where((F.col("user_id") != nobody) & F.col("content").isNotNull()).select("user_id", "created_at", "id", F.explode(profile(F.col("content"))).alias("key", "value"))
    g = m.groupBy("user_id", "key").agg(F.max_by(F.struct("value", F.col("created_at").alias("updated_at")), F.struct("created_at", "id")).alias("x")).select("user_id", "key", "x.*")
    if known is None:
        return g
    both = known.select("user_id", "key", "value", "updated_at").unionByName(g)
    return both.groupBy("user_id", "key").agg(F.max_by(F.struct("value", "updated_at"), "updated_at").alias("x")).select("user_id", "key", "x.*")


def prompt(memories: DataFrame) -> DataFrame:
    """(user_id, prompt): labelled lines, newest first."""
    label = F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))
    line = F.concat(F.lit("- "), F.coalesce(F.try_element_at(label, F.col("key")), F.col("key")), F.lit(": "), F.col("value"))
    g = memories.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("updated_at", line.alias("l"))), asc=False).alias("x"))  # a row per kind
    return g.select("user_id", F.array_join(F.transform("x", lambda v: v["l"]), "\n").alias("prompt"))


def owner(header: Column, query: Column, reserved: str = "default_user") -> Column:
    """The first user id given that isn't blank; null unless it has 1 to 64 of letters, digits and _.@- and isn't reserved."""
    v = F.coalesce(F.nullif(F.trim(header), F.lit("")), F.nullif(F.trim(query), F.lit("")))
    return F.when(v.rlike(r"^[A-Za-z0-9_.@-]{1,64}$") & (v != reserved), v)


def followups(answers: DataFrame, topics: DataFrame, limit: int = 2) -> DataFrame:
    """(id, question, place): up to `limit` next questions for answers (id, question, sources array<string>) from topics (topic, keywords, questions).

    A topic scores 100 for each keyword in the question and 1 for each in the sources. Topics meet
    answers by their keywords' first words, not all with all.
    """
    kw = topics.select("topic", F.explode("keywords").alias("kw")).withColumn("first", F.element_at(T.words(F.col("kw")), 1))
    a = answers.select("id", F.lower("question").alias("q"), F.lower(F.array_join("sources", " ")).alias("s"))
    w = a.select("id", "q", "s", F.explode(F.array_distinct(F.concat(T.words(F.col("q")), T.words(F.col("s"))))).alias("first"))
    hit = w.join(kw, "first").select("id", "topic", F.when(F.contains("q", F.lower("kw")), 100).otherwise(0).alias("x"), F.when(F.contains("s", F.lower("kw")), 1).otherwise(0).alias("y"))
    s = hit.groupBy("id", "topic").agg((F.sum("x") + F.sum("y")).alias("score")).where("score > 0")
    q = s.join(topics.select("topic", F.posexplode("questions").alias("pos", "next")), "topic").join(a.select("id", "q"), "id").where(F.lower("next") != F.col("q"))
    from pyspark.sql import Window

    q = q.groupBy("id", "next").agg(F.min(F.struct((-F.col("score")).alias("s"), "topic", "pos")).alias("k"))
    return q.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("k"))).where(F.col("place") <= limit).select("id", F.col("next").alias("question"), "place")


def of_user(memories: DataFrame, nobody: str = "default_user") -> DataFrame:
    """Memories with their place from the newest of their user; the user who stands for nobody has none."""
    from pyspark.sql import Window

    m = memories.where(F.col("user_id") != nobody)
    return m.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc_nulls_last("updated_at"), "key")))  # a row per kind


def hits(text: Column, needles: list[str]) -> Column:
    """How many of the needles a text holds, whatever the case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.size(F.filter(F.array(*map(F.lit, (n.lower() for n in needles))), lambda n: F.contains(low, n)))
