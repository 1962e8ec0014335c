"""Cutting oversized texts into overlapping pieces at natural boundaries.

A boundary is a place where a piece may end. The state of the cutting is the end of the last
piece: it fixes where the next piece starts (the overlap) and so the farthest legal end, its
successor. All successors are found by one sorted search; the ends that are really reached from
the start follow by pointer doubling: the successor table is squared again and again while the
set of reached ends is joined with its image, so m cuts take log2(m) steps instead of m.

Rules. The text is taken without blanks (space, tab, line feed, carriage return, form feed) at
its ends. The end of a piece is the farthest paragraph end in the last half of what is legal,
else line end, else sentence end, else the farthest word end; where none is legal the piece is
cut at the limit and called forced; a word that fits into a piece is never cut, the overlap
before it shrinks instead. A later piece starts with the last `overlap` characters of
the one before, less what it takes to start at a word; blanks between pieces belong to none.

Pages: a form feed starts the next entry of `pages`; a piece has the pages it touches, in order
of the text, each once. Beyond the last entry the last one holds; null or empty pages give an
empty list. Texts at or under the limit, null and blank texts give no rows. Equal rows are cut
once; a null id is kept as null. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1200, 100
BLANK = " \t\n\r\f"
_GAP = re.compile(r"[ \t\n\r\f]+")
_PARAGRAPH = re.compile(r"\f|\n[ \t\r]*\n|\r[ \t]*\r")
_SENTENCE = re.compile(r"[.!?…。！？][\"'”’»)\]*_]*$")


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of words, the starts of the words after them, and the rank of each end: 3 paragraph, 2 line, 1 sentence, 0 word. The last end is that of the text."""
    ends, starts, ranks = [], [], []
    for m in _GAP.finditer(text):
        g = m.group()
        if _PARAGRAPH.search(g):
            r = 3
        elif "\n" in g or "\r" in g:
            r = 2
        else:
            r = 1 if _SENTENCE.search(text, max(0, m.start() - 8), m.start()) else 0
        ends.append(m.start())
        starts.append(m.end())
        ranks.append(r)
    return np.array([*ends, len(text)]), np.array([*starts, len(text)]), np.array([*ranks, 3])


def _ends(ends: np.ndarray, starts: np.ndarray, limit: int) -> np.ndarray:
    """Ends with, in every word longer than the limit, the places where it may have to be cut: at each distance from the start of the word, counted from every possible start of a piece before it."""
    begin = np.r_[0, starts[:-1]]
    return np.flatnonzero(ends - begin > limit)


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, bool]]:
    """(start, end, forced) of the pieces of a text without blanks at its ends."""
    if len(text) <= limit:
        return [(0, len(text), False)] if text else []
    ends, starts, ranks = boundaries(text)
    words = np.r_[0, starts[:-1]]  # starts of words
    # nodes: the start of the text, all ends, and forced ends; a forced end is known by its place
    node = np.r_[0, ends]
    extra: list[int] = []
    for w in _ends(ends, starts, limit).tolist():
        e = int(ends[w - 1]) if w else 0
        s = int(_start(np.array([e]), words, starts, ends, overlap)[0]) if w else 0
        while s + limit < ends[w]:
            e = s + limit
            extra.append(e)
            s = e  # within a word there is no word to start at
    forced = np.array(sorted(extra), dtype=np.int64)
    pos = np.r_[node, forced]
    isf = np.r_[np.zeros(len(node), bool), np.ones(len(forced), bool)]
    order = np.argsort(pos, kind="stable")
    pos, isf = pos[order], isf[order]
    start = np.where(isf, pos, _start(pos, words, starts, ends, overlap))
    start[0] = 0
    # farthest legal end of each rank: ends up to start + limit, beyond pos
    top = np.searchsorted(ends, start + limit, "right") - 1
    best = np.full(len(pos), -1)
    for r in (0, 1, 2, 3):
        last = np.maximum.accumulate(np.where(ranks >= r, np.arange(len(ends)), -1))
        got = np.where(top >= 0, last[np.maximum(top, 0)], -1)
        where = ends[np.maximum(got, 0)]
        ok = (got >= 0) & (where > pos) & ((where > start + limit // 2) if r else True)
        best = np.where(ok, got, best)
    # no legal end, but the next word alone would fit: less overlap
    k = np.minimum(np.searchsorted(ends, pos, "right"), len(ends) - 1)
    shy = (best < 0) & ~isf & (ends[k] - words[np.minimum(k, len(words) - 1)] <= limit) & (ends[k] > pos)
    start = np.where(shy, words[np.minimum(np.searchsorted(words, ends[k] - limit), len(words) - 1)], start)
    best = np.where(shy, k, best)
    at_end = start + limit >= len(text)
    target = np.where(at_end, len(text), np.where(best >= 0, ends[np.maximum(best, 0)], start + limit))
    nxt = np.minimum(np.searchsorted(pos, target), len(pos) - 1)
    nxt[pos >= len(text)] = np.flatnonzero(pos >= len(text))
    # pointer doubling
    reached, table = np.array([0]), nxt
    while True:
        grown = np.union1d(reached, table[reached])
        if len(grown) == len(reached):
            break
        reached, table = grown, table[table]
    reached = reached[reached > 0]
    s = np.r_[0, start[reached[:-1]]]
    return list(zip(s.tolist(), pos[reached].tolist(), isf[reached].tolist(), strict=True))


def _start(pos: np.ndarray, words: np.ndarray, starts: np.ndarray, ends: np.ndarray, overlap: int) -> np.ndarray:
    """Where the piece after an end at pos starts: the first word start in the last `overlap` characters before pos, else the word after."""
    k = np.searchsorted(words, pos - overlap)
    first = words[np.minimum(k, len(words) - 1)]
    after = starts[np.minimum(np.searchsorted(ends, pos), len(starts) - 1)]
    return np.where((k < len(words)) & (first < pos), first, after)


def pages_of(text: str, start: int, end: int, pages: list[int] | None) -> list[int]:
    """The entries of pages that text[start:end] touches."""
    if pages is None or not len(pages):
        return []
    a = text.count("\f", 0, start)
    b = a + text.count("\f", start, end)
    got = [int(pages[min(i, len(pages) - 1)]) for i in range(a, b + 1) if pages[min(i, len(pages) - 1)] is not None]
    return list(dict.fromkeys(got))


PIECE = "chunk_id string, piece int, start int, length int, content string, pages array<int>, forced boolean"


def split_long(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of every chunk over the limit, one row each: chunk_id, piece from 0, start and length within the trimmed content, content, pages, forced."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be under half the limit")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for key, content, pages in zip(f["id"], f["content"], f["pages"], strict=True):
                text = content.strip(BLANK)
                lead = content[: len(content) - len(content.lstrip(BLANK))].count("\f")
                pages = pages if pages is None else [*pages[lead:]] or [*pages[-1:]]
                for k, (a, b, hard) in enumerate(cuts(text, limit, overlap)):
                    out.append((key, k, a, b - a, text[a:b], pages_of(text, a, b, pages), hard))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PIECE.split(", ")])

    body = F.regexp_replace("content", r"^[ \t\n\r\f]+|[ \t\n\r\f]+$", "")
    big = chunks.select("id", "content", "pages").where(F.length("content") > limit).where(F.length(body) > limit)
    one = big.groupBy("id", F.xxhash64("content").alias("_h")).agg(F.first("content").alias("content"), F.first("pages").alias("pages"))
    return one.select("id", "content", "pages").mapInPandas(run, PIECE)


def cut_kinds(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(chunk_id, cut): forced if a piece of the chunk was cut within a word, else natural."""
    p = split_long(chunks, limit, overlap)
    return p.groupBy("chunk_id").agg(F.when(F.max("forced"), "forced").otherwise("natural").alias("cut"))
