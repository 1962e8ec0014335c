"""Text helpers that several operators of this subpackage share."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that take no ink besides white space and format characters.
INKLESS = "͏ᅟᅠ឴឵⠀ㅤﾠ"
#: Java regular expression for a character that shows.
VISIBLE = r"[^\s\p{Z}\p{Cc}\p{Cf}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{2800}\x{3164}\x{FFA0}\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}]"
BLANKS = re.compile(r"[\s​⁠﻿]+")


def visible(c: Column) -> Column:
    """Whether c holds a character that shows; false for null."""
    return F.coalesce(c.rlike(VISIBLE), F.lit(False))


def trimmed(c: Column) -> Column:
    """c without white space of any kind, or format characters, at its ends."""
    return F.regexp_replace(c, r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$", "")


class _Folds(dict):
    """Of each character, worked out when first met: its lower-case compatibility decomposition without accents."""

    def __missing__(self, code: int) -> str:
        t = unicodedata.normalize("NFKD", chr(code).casefold().replace("đ", "d").replace("ð", "d"))
        out = self[code] = "".join(c for c in t if not unicodedata.combining(c)).casefold()  # a styled capital decomposes into a plain one
        return out


_FOLDS = _Folds()


def fold(text: str) -> str:
    """Lower case without accents; the stroked d counts as d. For comparing words, not for display."""
    return text.lower() if text.isascii() else text.translate(_FOLDS)
