"""Queries of this subpackage: each takes (spark, folder of the tables) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import answers, conversations, languages, leaks, lookalikes, neighbours, splitting, tokens
from vellum.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.dropped(table(spark, d, "chat_messages"))


def p1_turns(spark: SparkSession, d: str) -> DataFrame:
    return conversations.conversations(table(spark, d, "chat_messages"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.cut_kinds(table(spark, d, "chunks"))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_long(table(spark, d, "chunks"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    one = lambda t, k, c: table(spark, d, t).select(F.lit(f"{t}.{c}").alias("field"), F.col(k).cast("string").alias("key"), F.col(c).alias("text"))
    return one("semantic_cache", "entry_id", "query").unionByName(one("document_catalog", "id", "original_name")).unionByName(one("chat_messages", "id", "content"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.same_pairs(_texts(spark, d))


def p5_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every record that looks like a differently stored one, with its class."""
    return lookalikes.classes(_texts(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return answers.defects(table(spark, d, "semantic_cache"), languages.train(table(spark, d, "documents")))


def _entries(spark: SparkSession, d: str) -> DataFrame:
    one = lambda t: neighbours.units(table(spark, d, t), "entry_id", "vector")
    return one("semantic_cache").unionByName(one("cache_entries"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(_entries(spark, d))


def p4_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest of any cosine for every entry whose id is divisible by 100, against all entries."""
    return neighbours.nearest(_entries(spark, d), F.col("id") % 100 == 0)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.found(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return languages.cases(docs, languages.train(docs))


def p8_segments(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return languages.segments(docs, languages.train(docs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit()}
