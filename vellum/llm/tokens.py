"""Token ids of whole texts by a public byte-level tokenizer.

Overlapping chunk encoding. A text over `chunk` characters is cut into chunks that reach
`overlap` characters into both neighbours, and the chunks of one text go to many tasks. Around
each place where two chunks meet, both have the same overlap; it is pre-tokenised from two
starts, as the chunk before reads into it and as the chunk after begins. Where the boundaries of
the two scans resynchronise, both go on alike, and the chunks are stitched there: both sides find
the same place without asking each other. The pieces between the places are encoded in parallel
and put together in order. A scan that starts within a token is right from the first place where
a letter is followed by another kind of character, as no token spans that. If an overlap has no
common boundary (one token longer than it), its chunks hand on their texts, and these are
encoded together. Texts up to `chunk` characters are one piece. Decoding concatenates the bytes
of the tokens.

Defined results: null and empty texts get an empty list; strings that look like special tokens
are plain text; equal texts get equal ids; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDER, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern of the byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SURE = regex.compile(r"(?<=\p{L})\P{L}")
CHUNK, OVERLAP, MARGIN = 4_096, 256, 16


@lru_cache(maxsize=4)
def encoder(path: str):
    """The encoder of a vocabulary file, once per worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _pattern():
    return regex.compile(PATTERN)


def pre_tokens(text: str, first: int = 0) -> list[int]:
    """Places of text where pre-tokens begin, scanned from `first` on."""
    return [m.start() for m in _pattern().finditer(text, first)]


def stitch(text: str, at: int, margin: int) -> int:
    """The place from `at` on where the scans of an overlap from its start and from `at` resynchronise, clear of its end; -1 if there is none."""
    sure = _SURE.search(text)
    if not sure:
        return -1
    before = {p for p in pre_tokens(text) if p >= at and p > sure.start() and not text[p - 1].isspace()}  # a run of blanks is split by what follows it
    return next((p for p in pre_tokens(text, at) if p in before and p + margin <= len(text)), -1)


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            ids = [enc.encode_ordinary(t) if t else [] for t in texts]
            keep = [i for i, n in enumerate(b.schema.names) if n != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(ids, pa.list_(pa.int32()))], [*(b.schema.names[i] for i in keep), "ids"])

    return run


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = f"{FOLDER}/{VOCABULARY}", chunk: int = CHUNK, overlap: int = OVERLAP, margin: int = MARGIN) -> DataFrame:
    """(key, ids) of every row of docs."""
    from vellum.session import spread

    d = spread(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "key")
    kind = docs.schema[key].dataType.simpleString()
    small = d.where(F.coalesce(F.length("text"), F.lit(0)) <= chunk).mapInArrow(_encode(path), f"key {kind}, ids array<int>")
    long = _long(d.where(F.length("text") > chunk), chunk, overlap, margin, path, kind)
    return small.unionByName(long).select(F.col("key").alias(key), "ids")


def _pieces(path: str, chunk: int, overlap: int, margin: int):
    """Of chunks: the ids of the piece between its two stitches, or where one is missing, the text that has to be encoded with a neighbour's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            ids, rest, joined = [], [], []
            for no, last, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                own = min(no, 1) * overlap  # where the chunk's own part begins
                a = stitch(t[: 2 * overlap], own, margin) if no else 0
                z = len(t) if last else stitch(t[own + chunk - overlap :], overlap, margin)
                z = z if last or z < 0 else z + own + chunk - overlap
                piece = t[a if a >= 0 else own : z if z >= 0 else own + chunk]
                whole = a >= 0 and z >= 0
                ids.append(enc.encode_ordinary(piece) if whole else None)
                rest.append(None if whole else piece)
                joined.append(a < 0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(ids, pa.list_(pa.int32())), pa.array(rest, pa.string()), pa.array(joined, pa.bool_())], ["key", "row", "no", "ids", "rest", "joined"])

    return run


def _together(path: str):
    """Of texts: the ids of all their pieces in order; neighbouring rests are encoded as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            out = []
            for parts in b.column(1).to_pylist():
                ids, held = [], ""
                for p in parts:
                    if held and not p["joined"]:
                        ids += enc.encode_ordinary(held)
                        held = ""
                    if p["rest"] is None:
                        ids += p["ids"]
                    else:
                        held += p["rest"]
                out.append(ids + (enc.encode_ordinary(held) if held else []))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int32()))], ["key", "ids"])

    return run


def _long(d: DataFrame, chunk: int, overlap: int, margin: int, path: str, kind: str) -> DataFrame:
    if not 0 < margin < overlap <= chunk:
        raise ValueError("0 < margin < overlap <= chunk must hold")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, row, t in zip(b.column(0), b.column(1), b.column(2).to_pylist(), strict=True):
                for first in range(0, len(t), 256 * chunk):  # a very long text leaves in several batches
                    at = range(first, min(len(t), first + 256 * chunk), chunk)
                    texts = pa.array([t[max(0, i - overlap) : i + chunk + overlap] for i in at])
                    n = len(at)
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * n, b.schema.types[0]), pa.array([row.as_py()] * n), pa.array([i // chunk for i in at], pa.int32()), pa.array([i + chunk >= len(t) for i in at]), texts], ["key", "row", "no", "last", "text"])

    parts = d.select("key", F.monotonically_increasing_id().alias("row"), "text").mapInArrow(cut, f"key {kind}, row bigint, no int, last boolean, text string")
    parts = parts.repartition("row", "no")  # the chunks of one text go to many tasks
    e = parts.mapInArrow(_pieces(path, chunk, overlap, margin), f"key {kind}, row bigint, no int, ids array<int>, rest string, joined boolean")
    e = e.groupBy("key", "row").agg(F.array_sort(F.collect_list(F.struct("no", "ids", "rest", "joined"))).alias("parts"))
    return e.select("key", "parts").mapInArrow(_together(path), f"key {kind}, ids array<int>")


def decode(ids: list[int], path: str = f"{FOLDER}/{VOCABULARY}") -> str:
    """The text of ids: their bytes in order."""
    return encoder(path).decode_bytes(ids).decode("utf-8", errors="replace")
