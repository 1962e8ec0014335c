"""Boundaries to models: functions of batches of texts, with deterministic versions that need no model.

embed() turns texts into vectors and sparse weights through any callable; the default hashes
subwords. Texts are embedded once per distinct key. Judges and titles are callables of the same
kind. A failing model fails the task; nothing is silently left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as T

EMBEDDING = "struct<dense:array<float>,sparse:map<int,float>>"


def hashed(dim: int = 64, buckets: int = 1 << 18) -> Callable[[list[str]], list[tuple[list[float], dict[int, float]]]]:
    """An embedder by hashing: words and their trigrams for the dense vector (unit length), words for the sparse weights."""

    def run(texts: list[str]) -> list[tuple[list[float], dict[int, float]]]:
        out = []
        for t in texts:
            v, s = np.zeros(dim), {}
            for w in t.lower().split():
                k = zlib.crc32(w.encode())
                s[k % buckets] = s.get(k % buckets, 0.0) + 1.0
                for g in {w, *(w[i : i + 3] for i in range(max(1, len(w) - 2)))}:
                    h = zlib.crc32(g.encode(), 1)
                    v[h % dim] += 1 if h >> 31 else -1
            n = np.linalg.norm(v)
            out.append(((v / n if n else v).astype(np.float32).tolist(), s))
        return out

    return run


def embed(df: DataFrame, text: str, model: Callable | None = None, batch: int = 16) -> DataFrame:
    """df with dense and sparse of its text: distinct squeezed lower-case texts go to the model in batches, once each; null and blank texts get null."""
    f = model or hashed()

    @F.pandas_udf(EMBEDDING)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            got = [x for a in range(0, len(s), batch) for x in f(s.iloc[a : a + batch].tolist())]
            yield pd.DataFrame(got, columns=["dense", "sparse"])

    key = F.lower(T.squeeze(F.col(text)))
    d = df.withColumn("_key", F.when(key != "", key))
    e = d.select("_key").where("_key is not null").distinct().withColumn("_e", run("_key"))
    return d.join(e, "_key", "left").select(*df.columns, F.col("_e.dense").alias("dense"), F.col("_e.sparse").alias("sparse"))


def sparse_search(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank): the k largest sparse products of queries (query_id, sparse) and points (doc_id, sparse), by an equi-join on shared tokens."""
    from vellum.operators.retrieval import ranked

    p = points.select("doc_id", F.explode("sparse").alias("token", "dw"))
    q = queries.select("query_id", F.explode("sparse").alias("token", "qw"))
    return ranked(p.join(q, "token").groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("dw").cast("double") * F.col("qw")), 6).alias("score")), k)


def judge_prompt(question, answer, contexts):
    """What a judge is asked, as a column."""
    return F.format_string("Question:\n%s\n\nAnswer:\n%s\n\nSources:\n%s\n\nList the claims of the answer and whether the sources support each. Reply in JSON.", question, answer, F.array_join(contexts, "\n---\n"))


#: Fixed value: the pre-token pattern of the byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ENCODERS: dict[str, object] = {}


def counted(c, vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"):
    """The number of tokens of a text by a vocabulary file, 0 for null; distinct texts of a batch are counted once, without the tokenizer's library by 1.3 a word."""

    @F.pandas_udf("int")
    def run(s: pd.Series) -> pd.Series:
        enc = _encoder(vocabulary)
        codes, values = pd.factorize(s)
        n = [len(enc.encode_ordinary(x)) if enc else max(1, int(len(x.split()) * 1.3)) for x in values]
        return pd.Series(np.array([*n, 0])[codes], index=s.index)

    return run(c)


def _encoder(path: str):
    """The encoder of a vocabulary file, once a worker; None where its library is missing."""
    if path not in _ENCODERS:
        try:
            import base64

            import tiktoken
        except ImportError:
            return None
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("counted", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]
