"""What a question asks for, which part of an answer it means, and small helpers around answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions import text as T

# Phrases by which requests are recognised; the first list on plain keys, the second on lower-case text.
IMAGE_PHRASES = ["xem anh", "xem hinh", "trong anh", "trong hinh", "anh nay", "hinh nay", "buc anh", "buc hinh", "tam anh", "tam hinh", "picture", "image", "photo"]
TEXT_PHRASES = ["tóm tắt", "tom tat", "nội dung", "noi dung", "văn bản", "van ban", "chữ", "chu", "đọc", "doc", "ocr", "dịch", "dich", "ghi gì", "viet gi", "text", "trích", "trich", "ý chính", "y chinh", "main idea", "nói gì", "noi gi", "bài viết", "bai viet"]
NO_SOURCES = ["bảng", "context", "table", "nguồn", "nguon", "không rõ nguồn"]
ITEM_WORDS = "y|muc|dong|khoan|dieu|truong hop"


def about_image(c: Column) -> Column:
    return T.contains_any(T.plain_key(c), IMAGE_PHRASES)


def about_its_text(c: Column) -> Column:
    return T.contains_any(F.lower(c), TEXT_PHRASES)


def wants_table(c: Column) -> Column:
    return T.contains_any(T.plain_key(c), T.TABLE_PHRASES)


def referred_item(question: Column, answer: Column, few: int = 6) -> Column:
    """The part of an answer that a question means: the line that names the item by a word and its number, else the first line of at least 8 characters that holds the number; without a number the first `few` lines of at least 12 characters. Numbers before a line are no names, as they are taken off with the bullets."""
    n = F.regexp_extract(T.plain_key(question), rf"\b(?:{ITEM_WORDS}) (?:so )?(\d+)\b", 1)
    ls = F.filter(F.transform(F.split(answer, r"\r\n|\r|\n"), lambda x: T.strip_bullet(x)), lambda x: x != "")
    named = F.filter(ls, lambda x: F.regexp_extract(T.plain_key(x), rf"^(?:{ITEM_WORDS}) (?:so )?(\d+)\b", 1) == n)
    holding = F.filter(ls, lambda x: (F.length(x) >= 8) & F.array_contains(F.regexp_extract_all(x, F.lit(r"\d+"), F.lit(0)), n))
    first = F.array_join(F.slice(F.filter(ls, lambda x: F.length(x) >= 12), 1, few), "\n")
    got = F.when(n != "", F.coalesce(F.try_element_at(named, F.lit(1)), F.try_element_at(holding, F.lit(1)))).otherwise(first)
    return F.when(got != "", got)


def source_title(c: Column) -> Column:
    """A source's title without labels and brackets; '' for what names no source."""
    t = F.coalesce(c, F.lit(""))
    for p in (r"\[[^\]]*\]", r"(?i)\(\s*Nguồn:\s*", r"\)\s*$", r"(?i)^\s*Ngu[ồo]n:\s*"):
        t = F.regexp_replace(t, p, "")
    t = F.trim(F.regexp_replace(T.squeeze(t), r"^,\s*|,\s*$", ""))
    return F.when(F.lower(t).isin(NO_SOURCES) | ~T.is_source_name(t), "").otherwise(t)


def titles(c: Column) -> Column:
    """Titles of an array of sources, each once, in order."""
    return F.array_distinct(F.filter(F.transform(c, lambda x: source_title(x)), lambda x: x != ""))


def sigmoid(c: Column) -> Column:
    """Logistic function, 1 and 0 beyond 30."""
    return F.when(c > 30, 1.0).when(c < -30, 0.0).otherwise(1 / (1 + F.exp(-c)))


def replay(c: Column, pieces: int = 10) -> Column:
    """An answer in about `pieces` groups of words, each but the last with a blank at its end."""
    w = F.split(c, " ")
    step = F.ceil(F.size(w) / F.lit(float(pieces))).cast("int")
    n = F.size(w)
    return F.transform(F.sequence(F.lit(0), n - 1, step), lambda i: F.concat(F.array_join(F.slice(w, i + 1, step), " "), F.when(i + step < n, " ").otherwise("")))


def rough_text(c: Column) -> Column:
    """Markdown with its marks taken out."""
    for p, r in ((r"(?s)```.*?```|\$\$.*?\$\$", " "), (r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"https?://\S+", ""), (r"(?m)^\s*\|?\s*:?-{2,}.*$", ""), (r"[|*#_`>~]", " "), (r"%", " phần trăm")):
        c = F.regexp_replace(c, p, r)
    return T.squeeze(c)


def speech_key(text: Column, voice: Column, rate: Column) -> Column:
    return F.sha2(F.concat_ws("|", text, voice, rate), 256)


def audio_error(c: Column, most: int) -> Column:
    """empty, too large or unknown format; null for good audio."""
    return F.when(c.isNull() | (F.length(c) == 0), "empty").when(F.length(c) > most, "too large").when(T.audio_format(c).isNull(), "unknown format")


def image_prompt(question: Column) -> Column:
    """What a vision model is asked: to read the text, or to describe the picture."""
    return F.when(about_its_text(question), F.concat(F.lit("Read the text in the picture and answer: "), question)).otherwise(F.concat(F.lit("Describe what the picture shows and answer: "), question))
