"""Evaluation passages in training text.

Words of a passage and of a document are compared without case, accents, punctuation and
markup. The n-grams of `SEED` words of all passages are one table, those of the documents are
read in one scan, and the two meet in one equi-join; what a pair of document and item shares is
counted, and only pairs that share enough are aligned, whatever the number of items.

What a leak must share. A leak holds at least `share` of the words of a passage in seeds, and a
seed holds `SEED` words, so a leak shares at least share * words / SEED seed positions. Of these,
the ones most common among the items may be left out of the join as long as one is left that must
be shared beside them: so rarity orders the seeds and loses nothing, as a document that holds
only common wording still has to share the rest.

Documents send only n-grams that a filter of set bits knows. The filter has a fixed largest size;
past it, it lets more through, and the join stays exact.

Candidates are aligned by Smith-Waterman over words, again over what is left until no stretch is
found. An alignment bridges edits: `score` is the share of the passage's words that are aligned,
about 0.8 for a copy with every fifth word changed. Within alignments, stretches of at least
`run` equal words in a row give `words_matched`. A pair is reported if its stretches hold `share`
of the words, or if its score is at least `edited`.

Defined results: null and empty texts and passages match nothing; a passage of fewer than `run`
words counts as one stretch of its own length; rows without an id are left out, as they can't be
named; repeated document ids are scored per row and reported once; an item stored several times
counts once, by its largest passage; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.text import fold

RUN, SHARE, EDITED, SEED = 5, 1 / 3, 0.6, 4
#: Seeds that more items hold count as common; bits of the filter (at least per seed, at most in all, as powers of two); candidates that may be sent to every task.
COMMON, BITS_PER_SEED, MOST_BITS, SMALL = 8, 32, 28, 300_000
#: Words of a passage and of a text that are aligned at once, and how far neighbouring parts overlap; cells of the tables that are filled together.
PASSAGE, TEXT, LAP, CELLS = 2_048, 4_096, 512, 2_000_000
_TAG = re.compile(r"<[a-zA-Z/!][^<>\n]{0,200}>|&[a-zA-Z]{2,8};|\]\([^()\s]{0,300}\)")
_UNSEEN = re.compile("[­͏​-‏⁠-⁤︀-️﻿]")
_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """The words that are compared."""
    return _WORD.findall(_TAG.sub(" ", _UNSEEN.sub("", fold(text)))) if text else []


def grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of word hashes."""
    if len(codes) < n:
        return np.empty(0, np.uint64)
    k = len(codes) - n + 1
    h = np.zeros(k, np.uint64)
    for i in range(n):
        h = (h ^ codes[i : i + k]) * _MIX
        h ^= h >> np.uint64(29)
    return h


@lru_cache(maxsize=1)
def _odd() -> re.Pattern:
    """Characters that make folding a text differ from folding its words one by one: marks, unseen ones, and those that turn into or out of words."""
    ranges = [(0x0, 0x3400), (0xA000, 0xAC00), (0xD7A4, 0xD800), (0xE000, 0x10000)]  # without ideographs and syllables
    odd = []
    for a, b in ranges:
        for i in range(a, b):
            c = chr(i)
            f, own = fold(c), bool(_WORD.fullmatch(c))
            if not f or _UNSEEN.match(c) or own != bool(_WORD.fullmatch(f)) or (not own and _WORD.search(f)):
                odd.append(i)
    spans, start = [], None
    for x, y in zip(odd, [*odd[1:], -1]):
        start = x if start is None else start
        if y != x + 1:
            spans.append((start, x))
            start = None
    part = "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in spans)
    return re.compile(f"[{part}\\U00010000-\\U0001f2ff\\U0001fb00-\\U0010ffff]")


class Codes(dict):
    """64-bit hashes of words, each folded and hashed once; at most a million are held."""

    def __missing__(self, w: str) -> int:
        import xxhash

        if len(self) > 1_000_000:
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(fold(w))
        return h

    def of(self, text: str | None) -> list[int]:
        """Hashes of the words of a text."""
        if not text:
            return []
        if text.isascii() or not _odd().search(text):  # words may be folded one by one
            if "<" in text or "&" in text or "](" in text:
                text = _TAG.sub(" ", text)
            return [self[w] for w in _WORD.findall(text)]
        return [self[w] for w in words(text)]


def align(pairs: list[tuple[np.ndarray, np.ndarray]], run: int = RUN, match: int = 2, miss: int = -2, gap: int = -1) -> list[tuple[np.ndarray, np.ndarray]]:
    """Smith-Waterman over words of pairs (passage, text), repeated on what is left: for each pair, which words of the passage stand in stretches of at least `run` equal words in a row, and which are aligned at all.

    Tables of all pairs are filled together, row by row; gaps along the text are a running maximum.
    """
    got = [(np.zeros(len(p), bool), np.zeros(len(p), bool)) for p, _ in pairs]
    free = [p[:, None] == d[None, :] for p, d in pairs]  # equal words that are still free
    live = [k for k in range(len(pairs)) if free[k].any()]
    first = True
    while live:
        live.sort(key=lambda k: free[k].shape[1])
        at, after = 0, []
        while at < len(live):
            group = [live[at]]
            rows = free[live[at]].shape[0]
            while at + len(group) < len(live):
                more = free[live[at + len(group)]].shape
                if (len(group) + 1) * max(rows, more[0]) * more[1] > CELLS:
                    break
                rows = max(rows, more[0])
                group.append(live[at + len(group)])
            at += len(group)
            for k, table in zip(group, _tables([free[k] for k in group], match, miss, gap), strict=True):
                best = int(table.max())
                size = min(run, len(pairs[k][0]))
                if best >= match * size or first and best > 0:
                    _take(table, free[k], *got[k], size, match, miss, gap)
                    if _runs(free[k], size):
                        after.append(k)
        live, first = after, False
    return got


def _tables(free: list[np.ndarray], match: int, miss: int, gap: int) -> Iterator[np.ndarray]:
    rows, cols = max(f.shape[0] for f in free), max(f.shape[1] for f in free)
    gain = np.full((rows, len(free), cols), miss, np.int32)
    for k, f in enumerate(free):
        gain[: f.shape[0], k, : f.shape[1]][f] = match
    slope = -gap * np.arange(cols + 1, dtype=np.int32)
    table, row = np.zeros((rows + 1, len(free), cols + 1), np.int32), np.zeros((len(free), cols + 1), np.int32)
    for i in range(rows):
        np.maximum(table[i, :, :-1] + gain[i], table[i, :, 1:] + gap, out=row[:, 1:])
        row[:, 0] = 0
        np.maximum(row, 0, out=row)
        row += slope
        np.maximum.accumulate(row, axis=1, out=row)
        row -= slope
        table[i + 1] = row
    for k, f in enumerate(free):
        yield table[: f.shape[0] + 1, k, : f.shape[1] + 1]


def _take(table: np.ndarray, free: np.ndarray, stretches: np.ndarray, aligned: np.ndarray, run: int, match: int, miss: int, gap: int) -> None:
    """Follows the best alignment back, marks its words, and takes its stretches out of `free`; if it has none, the words it met."""
    i, j = (int(x) for x in np.unravel_index(int(table.argmax()), table.shape))
    path, parts, part = [], [], 0  # (word of the passage, word of the text), lengths of runs that end there
    while i and j and table[i, j]:
        if free[i - 1, j - 1] and table[i, j] == table[i - 1, j - 1] + match:
            i, j, part = i - 1, j - 1, part + 1
            path.append((i, j))
            continue
        if part:
            parts.append(part)
            part = 0
        if table[i, j] == table[i - 1, j - 1] + miss:
            i, j = i - 1, j - 1
        elif table[i, j] == table[i - 1, j] + gap:
            i -= 1
        else:
            j -= 1
    if part:
        parts.append(part)
    at, found = 0, False
    for n in parts:
        a, b = path[at + n - 1]
        aligned[a : a + n] = True
        if n >= run:
            stretches[a : a + n] = True
            free[a : a + n] = False
            free[:, b : b + n] = False
            found = True
        at += n
    if not found:
        for _, b in path:
            free[:, b] = False


def _runs(same: np.ndarray, run: int) -> bool:
    """Whether run equal words in a row are left anywhere."""
    if min(same.shape) < run:
        return False
    n, m = same.shape[0] - run + 1, same.shape[1] - run + 1
    left = same[:n, :m].copy()
    for i in range(1, run):
        left &= same[i : i + n, i : i + m]
    return bool(left.any())


def _parts(p: np.ndarray, d: np.ndarray, seed: int) -> list[tuple[slice, np.ndarray]]:
    """What is aligned of a pair: parts of the passage with the text around its seeds. Long ones are cut into parts that overlap, so no stretch is lost."""
    out = []
    for a in range(0, max(1, len(p) - LAP), PASSAGE - LAP):
        part = p[a : a + PASSAGE]
        n = min(seed, len(part))
        own, h = np.sort(grams(part, n)), grams(d, n)
        hit = np.flatnonzero(own[np.minimum(np.searchsorted(own, h), len(own) - 1)] == h) if len(own) and len(h) else np.zeros(0, int)
        if not len(hit):
            continue
        edge = np.zeros(len(d) + 1, np.int64)
        np.add.at(edge, np.maximum(hit - len(part), 0), 1)
        np.add.at(edge, np.minimum(hit + n + len(part), len(d)), -1)
        near = np.cumsum(edge)[:-1] > 0
        b = np.flatnonzero(np.diff(np.r_[False, near, False].astype(np.int8)))
        text = np.concatenate([x for s, e in zip(b[::2], b[1::2]) for x in (d[s:e], np.zeros(1, np.uint64))])  # 0 parts the pieces
        out += [(slice(a, a + PASSAGE), text[c : c + TEXT]) for c in range(0, max(1, len(text) - LAP), TEXT - LAP)]
    return out


def scores(pairs: list[tuple[np.ndarray, np.ndarray]], run: int = RUN, seed: int = SEED) -> list[tuple[int, float]]:
    """(words in stretches, aligned share) of pairs of passage and text as word hashes."""
    todo, owner = [], []
    for k, (p, d) in enumerate(pairs):
        for where, text in _parts(p, d, seed):
            todo.append((p[where], text))
            owner.append((k, where))
    marks = [(np.zeros(len(p), bool), np.zeros(len(p), bool)) for p, _ in pairs]
    for (k, where), (s, a) in zip(owner, align(todo, run), strict=True):
        marks[k][0][where] |= s
        marks[k][1][where] |= a
    return [(int(s.sum()), float(a.mean()) if len(a) else 0.0) for s, a in marks]


def _seeds(run: int, share: float, seed: int):
    """Of passages: the hash of each seed with its place."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = Codes()
        for f in frames:
            out = []
            for item, text in zip(f["item_id"], f["passage"], strict=True):
                c = np.array(codes.of(text), np.uint64)
                n = min(seed, len(c))
                if n:
                    g = grams(c, n)
                    out.append(pd.DataFrame({"item_id": item, "n": n, "least": max(1, int(np.ceil(share * len(c) / n - 1e-9))), "gram": g.view(np.int64)}))
            yield pd.concat(out) if out else pd.DataFrame({"item_id": [], "n": [], "least": [], "gram": []}).astype("int64")

    return read


def seeds(items: DataFrame, run: int = RUN, share: float = SHARE, seed: int = SEED, common: int = COMMON) -> DataFrame:
    """(gram, item_id, times, need, n): the seeds that join documents with items; a document with a leak has at least `need` of an item's seeds, counted by their times."""
    kind = items.schema["item_id"].dataType.simpleString()
    one = items.where("passage is not null and item_id is not null").groupBy("item_id").agg(F.max("passage").alias("passage"))
    g = one.mapInPandas(_seeds(run, share, seed), f"item_id {kind}, n int, least int, gram bigint").groupBy("gram", "item_id", "n", "least").agg(F.count("*").alias("times"))
    held = g.groupBy("gram").agg(F.count("*").alias("held"))  # items that have it
    per = g.join(held, "gram").groupBy("item_id", "n", "least").agg(F.array_sort(F.collect_list(F.struct((-F.col("held")).alias("rare"), "gram", "times"))).alias("g"))  # the commonest first; one passage
    # the commonest are left out while fewer than `least` positions are; `x` are places left out so far
    start = F.expr("struct(0L as x, cast(array() as array<struct<gram:bigint,times:bigint>>) as kept)")
    step = lambda a, s: F.when((-s["rare"] > common) & (a["x"] + s["times"] < F.col("least")) & (F.size(a["kept"]) == 0), F.struct((a["x"] + s["times"]).alias("x"), a["kept"].alias("kept"))).otherwise(F.struct(a["x"].alias("x"), F.concat(a["kept"], F.array(F.struct(s["gram"].alias("gram"), s["times"].alias("times")))).alias("kept")))
    per = per.withColumn("k", F.aggregate("g", start, step))
    return per.select("item_id", (F.col("least") - F.col("k.x")).alias("need"), "n", F.inline("k.kept"))


def _filter(kept: DataFrame, count: int) -> np.ndarray:
    """A set of bits for the seeds, of a size that is bounded whatever their number; each seed sets two."""
    power = int(min(MOST_BITS, max(16, np.ceil(np.log2(max(1, count) * BITS_PER_SEED)))))
    at = F.explode(F.array(F.shiftrightunsigned("gram", 64 - power) + 1, F.col("gram").bitwiseAND(F.lit((1 << power) - 1)) + 1))
    rows = kept.select(at.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits")).collect()  # at most 2**MOST_BITS bits in all
    out = np.zeros((1 << power) // 8, np.uint8)
    for r in rows:
        part = np.frombuffer(r.bits, np.uint8)
        a = (r.k - 1) * 4096
        out[a : a + 4096] = part[: len(out) - a]
    return out


def _hits(sent, sizes: list[int], kind: pa.DataType):
    """Of documents: their distinct n-grams that the filter knows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, codes = sent.value, Codes()
        power = (len(bits) * 8).bit_length() - 1
        low, high = np.uint64((1 << power) - 1), np.uint64(64 - power)
        has = lambda b: bits[(b >> np.uint64(3)).astype(np.int64)] >> (b & np.uint64(7)).astype(np.uint8) & 1
        for b in batches:
            lists = [codes.of(t) for t in b.column(1).to_pylist()]
            size = np.array([len(x) for x in lists])
            flat = np.fromiter((c for x in lists for c in x), np.uint64, int(size.sum()))
            doc, end = np.repeat(np.arange(len(lists)), size), np.repeat(np.cumsum(size), size)
            out_d, out_g = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for n in sizes:
                g = grams(flat, n)
                i = np.flatnonzero(has(g >> high)) if len(g) else np.zeros(0, np.int64)
                i = i[(has(g[i] & low) > 0) & (i + n <= end[i])] if len(i) else i  # none reaches into the next document
                out_d.append(doc[i])
                out_g.append(g[i])
            d, g = np.concatenate(out_d), np.concatenate(out_g)
            order = np.lexsort((g, d))
            d, g = d[order], g[order]
            keep = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (g[1:] != g[:-1])]) if len(d) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(d[keep])), pa.array(g[keep].view(np.int64))], schema=pa.schema([("doc_id", kind), ("gram", pa.int64())]))

    return scan


def _aligned(run: int, share: float, edited: float, seed: int):
    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, held = Codes(), {}
        for f in frames:
            pairs, last, d = [], None, None
            for text, item, passage in zip(f["text"], f["item_id"], f["passage"], strict=True):
                if text is not last:
                    last, d = text, np.array(codes.of(text), np.uint64)
                p = held.get(item)
                if p is None:
                    if len(held) > 20_000:
                        held.clear()
                    p = held[item] = np.array(codes.of(passage), np.uint64)
                pairs.append((p, d))
            got = [s for a in range(0, len(pairs), 512) for s in scores(pairs[a : a + 512], run, seed)]
            out = [(doc, item, w, len(p), s) for doc, item, (p, _), (w, s) in zip(f["doc_id"], f["item_id"], pairs, got, strict=True) if w and w >= share * len(p) - 1e-9 or s >= edited]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "words_matched", "passage_words", "score"])

    return check


def leaks(docs: DataFrame, items: DataFrame, run: int = RUN, share: float = SHARE, edited: float = EDITED, seed: int = SEED, common: int = COMMON) -> DataFrame:
    """(doc_id, item_id, words_matched, passage_words, score), one row per document and item that leaked into it, by stretches or as an edited copy."""
    from pyspark.sql.pandas.types import to_arrow_type

    from vellum.session import checkpointed, spread

    spark = docs.sparkSession
    kind, of = docs.schema["doc_id"].dataType, items.schema["item_id"].dataType.simpleString()
    hit = f"doc_id {kind.simpleString()}, item_id {of}, words_matched int, passage_words int, score double"
    kept = checkpointed(seeds(items, run, share, seed, common))
    there = {r.n: r.c for r in kept.groupBy("n").agg(F.count("*").alias("c")).collect()}  # at most `seed` sizes
    if not there:
        return spark.createDataFrame([], hit)
    sent = spark.sparkContext.broadcast(_filter(kept, sum(there.values())))
    texts = spread(docs.select("doc_id", "text"), "doc_id").where("doc_id is not null and text is not null and text <> ''")
    hits = texts.mapInArrow(_hits(sent, sorted(there), to_arrow_type(kind)), f"doc_id {kind.simpleString()}, gram bigint")
    shared = hits.join(kept.select("gram", "item_id", "times", "need"), "gram").groupBy("doc_id", "item_id", "need").agg(F.sum("times").alias("shared"))
    pairs = checkpointed(shared.where("shared >= need").select("doc_id", "item_id"))
    near = F.broadcast(pairs) if pairs.count() <= SMALL else pairs  # ids only; beyond it texts are shuffled to their candidates
    passages = items.where("passage is not null and item_id is not null").groupBy("item_id").agg(F.max("passage").alias("passage"))
    todo = texts.join(near, "doc_id").join(passages, "item_id").select("doc_id", "item_id", "text", "passage")
    out = todo.mapInPandas(_aligned(run, share, edited, seed), hit)
    return out.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("words_matched", "passage_words", "score")))


def found(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id) of the leaks whose stretches hold `share` of the passage's words."""
    return leaks(docs, items, share=share).where(F.col("words_matched") >= share * F.col("passage_words") - 1e-9).select("doc_id", "item_id")
