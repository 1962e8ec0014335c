"""Evaluation runs: answers and judgments made by models, resumable, and their report.

A run appends to a folder of JSON lines what isn't there yet, by item and configuration, so one
that broke off goes on where it stopped. Models are callables of a batch of rows; what a model
fails on is written with its error and tried again by the next run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import changes, evaluation

LINE = "id bigint, config string, said string, error string"


def done(spark: SparkSession, path: str) -> DataFrame:
    """(id, config, said) of what a run has made; of repeated lines one that isn't an error, the first by text."""
    from vellum.session import exists

    if not exists(spark, path):
        return spark.createDataFrame([], "id bigint, config string, said string")
    return spark.read.schema(LINE).json(path).where("error is null and said is not null").groupBy("id", "config").agg(F.min("said").alias("said"))


def made(wanted: DataFrame, path: str, model: Callable[[dict], str], batch: int = 16) -> int:
    """Asks model(row) for each wanted row (id, config, …) that isn't done, appends the lines, and returns how many were good."""
    from vellum.session import checkpointed

    todo = changes.todo(wanted, done(wanted.sparkSession, path), ["id", "config"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                try:
                    out.append((r["id"], r["config"], model(r), None))
                except Exception as e:  # whatever a model raises is a line, and is tried again by the next run
                    out.append((r["id"], r["config"], None, str(e) or type(e).__name__))
            yield pd.DataFrame(out, columns=["id", "config", "said", "error"])

    lines = checkpointed(todo.mapInPandas(run, LINE))
    lines.write.mode("append").json(path)
    return lines.where("error is null").count()


def summary_table(scores: DataFrame, metrics: list[str], by: str = "config", percent: tuple[str, ...] = (), rounds: int = 2000) -> DataFrame:
    """(metric, by, mean, low, high, n, shown): each metric's mean with a bootstrap interval, by configuration; one long table of values, so all intervals come from one pass."""
    pair = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))).alias("x")
    v = scores.select(by, pair).select(by, "x.metric", "x.value").where("value is not null")
    b = evaluation.bootstrap(v, by=["metric", by], rounds=rounds)
    plain = evaluation.shown_mean(F.col("mean"), F.col("low"), F.col("high"), F.col("n"))
    share = evaluation.shown_mean(F.col("mean"), F.col("low"), F.col("high"), F.col("n"), True)
    return b.withColumn("shown", F.when(F.col("metric").isin(*percent), share).otherwise(plain) if percent else plain)


def rendered(summary: DataFrame, by: str = "config") -> str:
    """The summary as a Markdown table, a row per metric and a column per configuration; as large as metrics times configurations."""
    rows = summary.select("metric", by, "shown").orderBy("metric", by).collect()
    kinds = sorted({r[by] for r in rows})
    cell = {(r.metric, r[by]): r.shown for r in rows}
    lines = [["metric", *kinds], ["---"] * (len(kinds) + 1), *([m, *(cell.get((m, k), "-") for k in kinds)] for m in sorted({r.metric for r in rows}))]
    return "\n".join(f"| {' | '.join(x)} |" for x in lines)


def disagreements(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Rows where two people's or a person's and a judge's decisions differ; rows with an open one are left out."""
    return pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))


def extremes(values: DataFrame, value: str, key: str, k: int = 6) -> DataFrame:
    """(n, least, median, most, lowest, highest): a column in one row, with the keys of its k smallest and largest values; the k of each task are merged."""
    v = values.where(F.col(value).isNotNull())
    m = evaluation.median_and_floor(v, [], value)
    low = v.orderBy(F.asc(value), key).limit(k).agg(F.array_sort(F.collect_list(F.struct(value, key))).alias("l"))
    high = v.orderBy(F.desc(value), key).limit(k).agg(F.array_sort(F.collect_list(F.struct((-F.col(value)).alias("v"), key))).alias("l"))
    names = lambda d: d.select(F.transform("l", lambda x: x[key])).scalar()
    return m.select("n", v.agg(F.min(value)).scalar().alias("least"), "median", v.agg(F.max(value)).scalar().alias("most"), names(low).alias("lowest"), names(high).alias("highest"))
