"""Column functions on text; null gives null unless said otherwise. All stay in the JVM but nfc(), which leaves it for texts that may not be composed."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _plain_letters() -> tuple[str, str]:
    """Composed Latin letters and their base letters, from the Unicode decompositions."""
    pairs = {}
    for i in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(i))[0]
        if base.isascii() and base.isalpha():
            pairs[chr(i)] = base
    pairs |= {"đ": "d", "Đ": "D"}
    return "".join(pairs), "".join(pairs.values())


_FROM, _TO = _plain_letters()

# Words and phrases of the domain, as plain text.
ABBREVIATIONS = [
    ("đrl", "điểm rèn luyện"),
    ("drl", "điểm rèn luyện"),
    ("hp", "học phần"),
    ("cpa", "điểm trung bình tích lũy CPA"),
    ("gpa", "điểm trung bình học kỳ GPA"),
    ("ctđt", "chương trình đào tạo"),
    ("ctdt", "chương trình đào tạo"),
    ("kktx", "ký túc xá"),
    ("ktx", "ký túc xá"),
    ("kltn", "khóa luận tốt nghiệp"),
    ("đatn", "đồ án tốt nghiệp"),
    ("datn", "đồ án tốt nghiệp"),
    ("gvcn", "giảng viên chủ nhiệm"),
    ("cbl", "cán bộ lớp"),
    ("bcl", "ban cán sự lớp"),
    ("bcs", "ban cán sự lớp"),
    ("pđt", "phòng đào tạo"),
    ("pdt", "phòng đào tạo"),
    ("cthssv", "phòng chính trị và công tác sinh viên"),
    ("khht", "kế hoạch học tập"),
    ("tkm", "thi kết thúc học phần"),
    ("nckh", "nghiên cứu khoa học"),
    ("cntt", "công nghệ thông tin"),
    ("ktpm", "kỹ thuật phần mềm"),
    ("khmt", "khoa học máy tính"),
    ("httt", "hệ thống thông tin"),
    ("attt", "an toàn thông tin"),
    ("bldt", "bảo lưu đào tạo"),
    ("xxtn", "xét công nhận tốt nghiệp"),
]
SYNONYMS = [
    (r"điểm đầu vào", "điểm chuẩn tuyển sinh"),
    (r"điểm trúng tuyển", "điểm chuẩn tuyển sinh"),
    (r"chỉ tiêu(?! tuyển sinh)", "chỉ tiêu tuyển sinh"),
    (r"hạ (?:loại )?bằng", "giảm mức xếp loại tốt nghiệp"),
    (r"cộng điểm rèn luyện", "khung đánh giá kết quả rèn luyện"),
    (r"thành tựu", "thành tích, danh hiệu, giải thưởng"),
]
FILLERS = "cho em mình tôi tớ con bạn ad admin hỏi hãy ạ ơi với nhé nha nhỉ vậy đi giúp xin ơn vui lòng là thì được để của các những và cái về biết muốn gì dạ vâng".split()
TABLE_PHRASES = "diem chuan|hoc phi|chung chi|tuong duong|tham chieu|muc diem|thang diem|quy doi|xep loai|danh sach|bao gom|gom nhung gi|cac muc|cac nhom|cac bac|cac to chuc|cac co so|doi chieu|so sanh|cac nganh|khoa kinh te|khoa cong nghe thong tin|cntt|bang|in ra bang|dang bang|trinh bay dang bang".split("|")
IMAGE_ENDINGS = "png|jpg|jpeg|webp|gif|bmp"


def fold_accents(c: Column) -> Column:
    """Letters without accents, composed or combining; the stroked d counts as d."""
    return F.regexp_replace(F.translate(c, _FROM, _TO), r"\p{Mn}", "")


def squeeze(c: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def plain_key(c: Column) -> Column:
    """Accent- and case-insensitive key: only a-z, 0-9 and single blanks; null as ''."""
    low = fold_accents(F.lower(F.coalesce(c, F.lit(""))))
    return squeeze(F.regexp_replace(low, r"[^a-z0-9\s]", " "))


def contains_any(c: Column, phrases: list[str]) -> Column:
    """Whether c holds one of the phrases as it stands: one pass by an alternation."""
    quoted = "|".join("\\Q" + p + "\\E" for p in phrases)
    return F.coalesce(c.rlike(quoted), F.lit(False))


def strip_bullet(c: Column) -> Column:
    """A line without one run of bullets and one number before it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"^\s*[-*•]+\s*", ""), r"^\s*\d+[.)]\s*", ""))


def base_name(c: Column) -> Column:
    """The last component of a path with either slash."""
    return F.substring_index(F.translate(c, "\\", "/"), "/", -1)


def file_stem(c: Column) -> Column:
    return F.regexp_replace(base_name(c), r"\.[^.]*$", "")


def file_ending(c: Column) -> Column:
    """The ending in lower case with its dot, '' without one."""
    return F.lower(F.regexp_extract(c, r"\.[^./\\]+$", 0))


def name_key(c: Column) -> Column:
    """File names for comparison: lower case without blanks, underscores and hyphens."""
    return F.translate(F.lower(c), " _-", "")


def is_source_name(c: Column) -> Column:
    """Whether a source may be named: not blank and no image."""
    return F.coalesce((F.trim(c) != "") & ~F.lower(c).rlike(rf"\.(?:{IMAGE_ENDINGS})$"), F.lit(False))


def expand(c: Column, pairs: list[tuple[str, str]] | None = None, synonyms: list[tuple[str, str]] | None = None) -> Column:
    """c with the full form in brackets behind each abbreviation, rule by rule on the growing text; a synonym is left out if its expansion is there already."""
    out = F.coalesce(c, F.lit(""))
    for short, full in ABBREVIATIONS if pairs is None else pairs:
        out = F.regexp_replace(out, rf"(?iU)\b({short})\b", f"$1 ({full})")
    for short, full in SYNONYMS if synonyms is None else synonyms:
        out = F.when(F.contains(F.lower(out), F.lit(full.lower())), out).otherwise(F.regexp_replace(out, rf"(?iU)\b({short})\b", f"$1 ({full})"))
    return out


def unabbreviate(c: Column, pairs: list[tuple[str, str]] | None = None) -> Column:
    """c with each abbreviation replaced by its full form."""
    return reduce(lambda x, p: F.regexp_replace(x, rf"(?iU)\b{p[0]}\b", p[1]), ABBREVIATIONS if pairs is None else pairs, F.coalesce(c, F.lit("")))


def words(c: Column) -> Column:
    """Lower-case words: runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def numbers(c: Column) -> Column:
    """The distinct numbers of a text in order of place, a comma as a point."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\d+(?:[.,]\d+)?"), F.lit(0)), lambda x: F.translate(x, ",", ".")))


def same_numbers(a: Column, b: Column) -> Column:
    return F.array_sort(numbers(a)) == F.array_sort(numbers(b))


def content_words(c: Column, fillers: list[str] | None = None) -> Column:
    """Words that carry the meaning of a question, in order: phrases for `how` as one word, numbers whole, without fillers."""
    t = F.regexp_replace(F.lower(c), r"(?U)\b(?:như\s+thế\s+nào|thế\s+nào|ra\s+sao|như\s+nào)\b", " thế_nào ")
    got = F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(r"\d+(?:[.,]\d+)?|[\p{L}\p{N}_]+"), F.lit(0))
    stop = F.array(*map(F.lit, FILLERS if fillers is None else fillers))
    return F.transform(F.filter(got, lambda x: ~F.array_contains(stop, x)), lambda x: F.translate(x, ",", "."))


def canonical(c: Column) -> Column:
    return F.array_join(content_words(c), " ")


def estimated_tokens(c: Column) -> Column:
    """A quarter of the characters, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(c, F.lit(""))) / 4)).cast("int")


def token_length(c: Column) -> Column:
    """1.3 times the words, at least 1."""
    w = F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda x: x != ""))
    return F.greatest(F.lit(1), F.floor(w * F.lit(1.3))).cast("int")


def overlap_tail(c: Column, n: int) -> Column:
    """The last n characters from the first blank in them; '' for a text of at most n or without a blank."""
    tail = F.substring(c, -n, n)
    at = F.locate(" ", tail)
    return F.when((F.length(c) <= n) | (at == 0), "").otherwise(F.trim(F.substr(tail, at + 1)))


def size_text(c: Column) -> Column:
    """Bytes with a unit, to one decimal, by 1024."""
    u = F.when(c < 1024, F.concat(c.cast("string"), F.lit(" B")))
    u = u.when(c < 1024**2, F.concat(F.format_number(c / 1024, 1), F.lit(" KB")))
    u = u.when(c < 1024**3, F.concat(F.format_number(c / 1024**2, 1), F.lit(" MB")))
    return u.otherwise(F.concat(F.format_number(c / 1024**3, 1), F.lit(" GB")))


def file_kind(c: Column) -> Column:
    e = file_ending(c)
    return F.when(e == ".pdf", "pdf").when(e.isin(".doc", ".docx"), "word").when(e.isin(".xls", ".xlsx", ".csv"), "sheet").when(e.isin(".ppt", ".pptx"), "slides").when(e.isin(".png", ".jpg", ".jpeg", ".webp", ".gif", ".bmp"), "image").when(e.isin(".txt", ".md"), "text").otherwise("other")


def pretty_title(c: Column) -> Column:
    """A file name as a title: without ending, underscores as blanks."""
    return squeeze(F.translate(F.regexp_replace(c, r"\.[A-Za-z0-9]{1,5}$", ""), "_", " "))


def slug(c: Column, most: int = 60, default: str = "item") -> Column:
    """Lower case, runs of other than word characters as one hyphen, at most `most` characters."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^\w-]+", "-"), r"^-+|-+$", "")
    s = F.substring(s, 1, most)
    return F.when(s == "", default).otherwise(s)


def short_title(c: Column, most: int = 60) -> Column:
    """The first characters of a text as a title, with dots if more follow."""
    t = squeeze(c)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("..."))).otherwise(t)


def clean_cell(c: Column) -> Column:
    """A table cell on one line, bars as slashes; null as ''."""
    return squeeze(F.translate(F.coalesce(c, F.lit("")), "|", "/"))


def clean_lines(c: Column) -> Column:
    """Text with plain blanks and line ends: no blanks at line ends, at most one empty line in a row."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n"), r"[\t\x{00A0}]", " ")
    t = F.regexp_replace(F.regexp_replace(t, r" {2,}", " "), r" *\n *", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\n+|\n+$", ""))


def articles(c: Column) -> Column:
    """The distinct numbers of cited articles, sorted."""
    got = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?iU)\b(?:điều|dieu)\s+(\d+)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(got, lambda x: x.cast("int"))))


def cites(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(?iU)\b(?:điều|khoản)\s+\d+"), F.lit(False))


def unfence(c: Column) -> Column:
    """Text without a Markdown fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def has_table(c: Column) -> Column:
    """Whether a line with bars is followed by a separator line."""
    return F.coalesce(c.rlike(r"(?m)^\s*\|.*\n\s*\|[:\-\s|]*-[:\-\s|]*$"), F.lit(False))


def key_value(c: Column) -> Column:
    """struct(key, value) of a line at its first separator, by priority `:`, ` - `, ` – `, ` — `; null without one."""
    out = None
    for sep in (":", " - ", " – ", " — "):
        k = F.trim(F.substring_index(c, sep, 1))
        v = F.trim(F.substr(c, F.locate(sep, c) + F.lit(len(sep))))
        hit = F.contains(c, F.lit(sep)) & (k != "") & (v != "")
        s = F.struct(k.alias("key"), v.alias("value"))
        out = F.when(hit, s) if out is None else out.when(hit, s)
    return out


def audio_format(c: Column) -> Column:
    """Format of audio bytes by their first ones; null if unknown or under 12 bytes."""
    h = F.hex(F.substring(c, 1, 12))
    k = F.when(h.startswith("1A45DFA3"), "webm").when(h.startswith("4F676753"), "ogg").when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57415645"), "wav")
    k = k.when(h.startswith("494433") | h.rlike("^FF(?:FB|F3|F2)"), "mp3").when(F.substring(h, 9, 8) == "66747970", "m4a").when(h.startswith("664C6143"), "flac")
    return F.when(F.length(c) >= 12, k)


def nfc(c: Column) -> Column:
    """Text in composed form; only texts with combining characters or singletons leave the JVM, once per distinct value of a batch."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        import unicodedata

        return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    odd = c.rlike(r"[\p{M}\x{0340}-\x{0387}\x{1100}-\x{11FF}\x{2000}-\x{2001}\x{2126}\x{212A}\x{212B}\x{2329}\x{232A}\x{0958}-\x{0A5E}\x{0B5C}-\x{0B5D}\x{0F43}-\x{0FB9}\x{1F71}-\x{1FFD}\x{2ADC}\x{F900}-\x{FB4E}\x{11099}-\x{2FA1D}]")
    return F.when(~odd, c).otherwise(run(F.when(odd, c)))


def question_norm(c: Column) -> Column:
    """Questions as a cache compares them: composed, lower case, single blanks."""
    return F.lower(squeeze(nfc(c)))


def escaped_cell(c: Column) -> Column:
    """A text as a cell of a Markdown table."""
    return F.replace(squeeze(c), F.lit("|"), F.lit("\\|"))


def tagless(c: Column) -> Column:
    """Breaks as blanks and angle brackets of tags as square ones."""
    return F.regexp_replace(F.regexp_replace(c, r"(?i)<br\s*/?>", " "), r"<([^<>]+)>", "[$1]")


def said_text(parts: Column, text: Column) -> Column:
    """The text of a streamed piece: its parts together, else its own text; '' without either."""
    whole = F.array_join(F.filter(F.coalesce(parts, F.array().cast("array<string>")), lambda x: x.isNotNull()), "")
    return F.coalesce(F.nullif(whole, F.lit("")), text, F.lit(""))


def unique_lines(c: Column) -> Column:
    """A text without lines that stood before, whatever their case and blanks; blank lines stay."""
    ls = F.split(c, "\n")
    key = lambda x: F.lower(squeeze(x))
    step = lambda a, x: F.when((key(x) != "") & F.array_contains(a["seen"], key(x)), a).otherwise(F.struct(F.concat(a["seen"], F.array(key(x))).alias("seen"), F.concat(a["kept"], F.array(x)).alias("kept")))
    none = F.array().cast("array<string>")
    return F.aggregate(ls, F.struct(none.alias("seen"), none.alias("kept")), step, lambda a: F.array_join(a["kept"], "\n"))
