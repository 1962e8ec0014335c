"""One form for texts that look the same but are stored in different characters.

Composed compatibility normalisation as far as it keeps what a reader sees, look-alike letters
to Latin ones, white space mapped, default-ignorable characters removed. Plain NFKC and case
folding would also join raised digits with plain ones and capitals with small letters; a reader
sees these, so the form keeps compatibility characters whose decomposition is a raised, lowered,
circled, squared, font or fraction form, and folds case only if asked (fold_case).

Most texts are their own form: two patterns in the JVM tell them, and of these only a 128-bit
digest of the text goes on. All others go to Python in Arrow batches, each distinct value of a
batch once. Two different texts of one form can't both be that form, so a form that is stored in
several ways shows among the others; records meet by the digest of their form, texts never do.

Defined results: null stays null; a text with nothing visible gets the empty form and is never
compared; blanks at the ends and runs of blanks count as one blank, line breaks stay line
breaks; a key that is stored several times with one text is one record.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of other scripts that look like Latin ones, by the public confusables data.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХаеорсухіјѕһԁԛԝѵ", "ABESIJKMHOPCTYXaeopcyxijshdqwv", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοναιρυϲϳ", "ABEZHIKMNOPTYXovaipucj", strict=True))
#: The strokes through D, hyphens, and letters without a decomposition.
OTHERS = {"Ð": "Đ", "Ɖ": "Đ", "‐": "-", "‑": "-", "‒": "-", "﹣": "-", "ɡ": "g", "ɑ": "a", "ℓ": "l", "։": ":", "∶": ":", "ꓸ": "."}
#: Kinds of compatibility decomposition that don't change what is seen.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<compat>", "<isolated>", "<initial>", "<medial>", "<final>")
#: Ranges of default-ignorable characters (Unicode derived property) and other format characters.
IGNORABLE = re.compile(
    "[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￰-￸\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff]"
)
#: A joiner between two pictures changes the picture, so it stays.
_JOINED = re.compile("(?<=[←-⯿️\U0001f000-\U0001faff])‍(?=[←-⯿\U0001f000-\U0001faff])")
#: Parts into which the records of a text are dealt when pairs are opened.
SALTS = 8
_BLANK = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n ?")
#: Java expression of texts that need no Python: printable ASCII and composed Latin letters.
PLAIN = r"^[\x20-\x7E\n\xC0-\xCF\xD1-\xD6\xD8-\xF6\xF8-\x{0131}\x{0134}-\x{013E}\x{0141}-\x{0148}\x{014A}-\x{017E}\x{01A0}\x{01A1}\x{01AF}\x{01B0}\x{1E00}-\x{1E99}\x{1EA0}-\x{1EF9}]*$"


#: Blanks that the form changes: at the ends, in runs, and around line breaks.
LOOSE = r"^[ \n]|[ \n]$|  |\n | \n"


class _Looks(dict):
    """Of each character of a decomposed text what is seen, worked out when first met."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c.isspace():
            c = "\n" if c in "\n\r\x0b\x0c\x85\u2028\u2029" else " "
        else:
            kind, _, rest = unicodedata.decomposition(c).partition("> ")
            if f"{kind}>" in SAME_LOOK and not rest.startswith("0020"):
                c = unicodedata.normalize("NFKC", c)
        self[code] = c
        return c


_LOOKS = _Looks()


def same_look(text: str | None, fold_case: bool = False) -> str | None:
    """The form of one text."""
    if text is None:
        return None
    text = unicodedata.normalize("NFD", text.replace("\r\n", "\n"))
    text = "\u200d".join(IGNORABLE.sub("", part).translate(_LOOKS) for part in _JOINED.split(text))
    text = unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(_TABLE)).translate(_TABLE)
    text = _LINES.sub("\n", _BLANK.sub(" ", text)).strip()
    return unicodedata.normalize("NFC", text.casefold()) if fold_case else text


_TABLE = str.maketrans(CYRILLIC | GREEK | OTHERS)


def _odd(fold_case: bool):
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        codes, values = pd.factorize(s)
        forms = pd.array([same_look(x, fold_case) for x in values] + [None], object)  # code -1, the last, is null
        return pd.Series(forms[codes], index=s.index, dtype=object)

    return run


def settled(c: Column) -> Column:
    """Whether a text is its own form, letter case apart."""
    return c.rlike(PLAIN) & ~c.rlike(LOOSE)


def form(c: Column, fold_case: bool = False) -> Column:
    """The form of a text column. Only texts that aren't settled reach Python."""
    fine = settled(c) & c.rlike(r"^[\x20-\x7E\n]*$") if fold_case else settled(c)
    return F.when(fine, F.lower(c) if fold_case else c).otherwise(_odd(fold_case)(F.when(fine, None).otherwise(c)))


def digest(c: Column) -> Column:
    """128 bits of a text."""
    return F.unhex(F.md5(c))


def members(rows: DataFrame) -> DataFrame:
    """(field, key, form, text): records (field, key, text) of the forms that are stored in more than one way, form and text as digests.

    A key that is stored several times with one text is one record; with two texts it is two.
    """
    from vellum.session import checkpointed

    rows = rows.select("field", "key", "text").where("text is not null and key is not null and field is not null")
    plain = settled(F.col("text"))
    d = digest(F.col("text"))
    same = rows.where(plain & (F.col("text") != "")).select("field", "key", d.alias("form"), d.alias("text"))
    odd = rows.where(~plain).withColumn("form", _odd(False)(F.col("text"))).where("form <> ''")
    odd = checkpointed(odd.select("field", "key", digest(F.col("form")).alias("form"), d.alias("text")))
    shown = odd.where("form <> text").select("field", "form").distinct()  # only these can have two ways
    m = checkpointed(same.unionByName(odd).join(shown, ["field", "form"], "left_semi").distinct())
    many = m.groupBy("field", "form").agg(F.min("text").alias("a"), F.max("text").alias("z")).where("a < z").select("field", "form")
    return m.join(many, ["field", "form"], "left_semi")


def classes(rows: DataFrame) -> DataFrame:
    """(field, key, first, ways, records) of every record that looks like a differently stored one: a class is named by the smallest text of it; ways are its distinct texts. A row per record, so a class of any size costs no pairs."""
    m = members(rows)
    per = m.groupBy("field", "form", "text").agg(F.count("*").alias("n")).groupBy("field", "form").agg(F.count("*").alias("ways"), F.sum("n").alias("records"))
    stored = rows.where("text is not null").select("field", "key", F.col("text").alias("stored"))
    named = m.join(stored, ["field", "key"]).where(digest(F.col("stored")) == F.col("text")).groupBy("field", "form").agg(F.min("stored").alias("first"))
    return m.join(per, ["field", "form"]).join(named, ["field", "form"]).select("field", "key", "first", "ways", "records").distinct()


def same_pairs(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """(field, key_a, key_b), key_a < key_b: pairs of records of one field whose texts differ as stored but have one form.

    Texts are joined with texts of their class, and only then opened into their records, in
    `salts` parts each, so copies of one text never meet each other and a text that very many
    records have is spread.
    """
    from vellum.session import checkpointed

    m = checkpointed(members(rows))
    v = m.select("field", "form", "text").distinct()
    pairs = v.select("field", "form", F.col("text").alias("a")).join(v.select("field", "form", F.col("text").alias("b")), ["field", "form"]).where("a < b").select("field", "a", "b")
    salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    part = F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int").alias("salt")  # only deals records out
    left = m.select("field", F.col("text").alias("a"), F.col("key").alias("ka"), part)
    right = m.select("field", F.col("text").alias("b"), F.col("key").alias("kb"))
    p = pairs.select("*", salt).join(left, ["field", "a", "salt"]).drop("salt").join(right, ["field", "b"])
    return p.where("ka <> kb").select("field", F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b")).distinct()
