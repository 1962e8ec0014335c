"""Ordered analytics over keys of any size.

A window partitioned by a key alone puts all its rows in one task. Here the order column (a
number) is cut into buckets of `width`; rows meet within (key, bucket), and only one row per
bucket is carried along the key. Results equal those of the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 100_000


def _bucket(order: Column, width: float) -> Column:
    return F.floor(order / F.lit(width))


def last_before(df: DataFrame, keys: list[str], order: str, value: Column, name: str, width: float = WIDTH, ties: list[str] | None = None) -> DataFrame:
    """df with the last non-null value among earlier rows of the key, as `name`; null where there is none. Rows without an order value come first."""
    d = df.withColumn("_v", value).withColumn("_b", _bucket(F.coalesce(F.col(order), F.lit(-1)), width))
    by = [F.col(order).asc_nulls_first(), *(ties or [])]
    within = F.last("_v", ignorenulls=True).over(Window.partitionBy(*keys, "_b").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1))
    ends = d.where(F.col("_v").isNotNull()).groupBy(*keys, "_b").agg(F.max_by("_v", F.struct(order, *(ties or []))).alias("_e"))
    full = d.select(*keys, "_b").distinct().join(ends, [*keys, "_b"], "left")
    carried = full.withColumn("_c", F.last("_e", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).drop("_e")
    return d.withColumn("_w", within).join(carried, [*keys, "_b"], "left").withColumn(name, F.coalesce("_w", "_c")).drop("_v", "_b", "_w", "_c")


def positions(df: DataFrame, keys: list[str], order: str, name: str, width: float = WIDTH, ties: list[str] | None = None) -> DataFrame:
    """df with the place of each row in its key's order, from 1."""
    d = df.withColumn("_b", _bucket(F.coalesce(F.col(order), F.lit(-1)), width))
    n = d.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    base = n.withColumn("_base", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b")) - F.col("_n")).drop("_n")
    w = Window.partitionBy(*keys, "_b").orderBy(F.col(order).asc_nulls_first(), *(ties or []))
    return d.withColumn("_r", F.row_number().over(w)).join(base, [*keys, "_b"]).withColumn(name, (F.col("_base") + F.col("_r")).cast("bigint")).drop("_b", "_r", "_base")
