"""Stage times, rate limits and health as tables."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.operators import evaluation


def stage_stats(times: DataFrame, stage: str = "stage", ms: str = "ms") -> DataFrame:
    """(stage, n, p50, p95, max): nearest-rank percentiles of the times of each stage, to one decimal."""
    p = evaluation.percentiles(times, [stage], ms, {"p50": 0.5, "p95": 0.95})
    return p.select(stage, "n", *(F.round(c, 1).alias(c) for c in ("p50", "p95", "max")))


def newest(times: DataFrame, by: str, order: str, tie: str, n: int) -> DataFrame:
    """The newest n records of each label, as a ring buffer keeps them; at most n of a label leave each task."""
    w = Window.partitionBy(by).orderBy(F.desc(order), F.desc(tie))
    return times.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def totals(marks: DataFrame) -> DataFrame:
    """(request, stage, ms): times of a stage that was marked several times, added, to one decimal."""
    return marks.groupBy("request", "stage").agg(F.round(F.sum("ms"), 1).alias("ms"))


def client(c: Column) -> Column:
    """The first address of a chain of forwarders."""
    return F.trim(F.substring_index(c, ",", 1))


def rate_limited(hits: DataFrame, limit: int, seconds: int, key: str = "user_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Hits (key, ts, tie) with `accepted` and `retry_after` seconds under a sliding log: a hit is accepted if fewer than `limit` accepted ones lie within the last `seconds`; rejected ones are not counted.

    Whether a hit is accepted depends on the decisions before, so hits of a key are read in order.
    A gap of more than `seconds` without any hit forgets everything: runs between such gaps are
    independent and spread by key and run, so a key with any share of the rows is spread too. Hits
    without a key or a time are left out.
    """
    from vellum.operators.segments import last_before

    us, reach = F.unix_micros(F.col(ts).cast("timestamp")), seconds * 1_000_000
    # Ties at one time must share a bucket; hits are ordered by time, then tie.
    h = hits.withColumn("_us", us).where("_us is not null")
    h = last_before(h, [key], "_us", F.col("_us"), "_p", seconds * 1_000_000 * 60, [tie])
    h = h.withColumn("_new", (F.col("_p").isNull() | (F.col("_us") - F.col("_p") > seconds * 1_000_000)).cast("int"))
    h = last_before(h, [key], "_us", F.when(F.col("_new") == 1, F.col("_us")), "_run", seconds * 1_000_000 * 60, [tie])
    h = h.withColumn("_run", F.when(F.col("_new") == 1, F.col("_us")).otherwise(F.col("_run"))).drop("_p", "_new")
    out = T.StructType([*hits.schema.fields, T.StructField("accepted", T.BooleanType()), T.StructField("retry_after", T.DoubleType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, log = None, deque()
        for f in frames:
            ok, wait = [], []
            for k, r, t in zip(f[key], f["_run"], f["_us"], strict=True):
                if (k, r) != now:
                    now, log = (k, r), deque()
                while log and t - log[0] > reach:
                    log.popleft()
                ok.append(len(log) < limit)
                wait.append(None if ok[-1] else (reach - (t - log[0])) / 1e6)
                if ok[-1]:
                    log.append(t)
            yield f.drop(columns=["_us", "_run"]).assign(accepted=ok, retry_after=pd.array(wait, "Float64"))[out.names]

    h = h.select(*hits.columns, "_us", "_run").where(F.col(key).isNotNull()).repartition(key, "_run").sortWithinPartitions(key, "_run", "_us", tie)
    return h.mapInPandas(run, out)


def healthy(checks: DataFrame) -> DataFrame:
    """One row: whether all components are well, and which aren't."""
    return checks.agg(F.bool_and("ok").alias("ok"), F.array_sort(F.collect_set(F.when(~F.col("ok"), F.col("component")))).alias("failing"))


class Stages:
    """Times of the stages of one request, in milliseconds: a stage marked several times adds up, offsets from the start are kept once."""

    def __init__(self, request: str, clock=None):
        import time

        self.request, self.clock = request, clock or time.perf_counter
        self.began, self.times, self.offsets = self.clock(), {}, {}

    def mark(self, stage: str, ms: float) -> None:
        self.times[stage] = self.times.get(stage, 0.0) + ms

    def since_start(self, stage: str) -> None:
        self.offsets.setdefault(stage, (self.clock() - self.began) * 1000)

    def stage(self, name: str):
        """A block whose time counts, also if it fails."""
        from contextlib import contextmanager

        @contextmanager
        def timed():
            a = self.clock()
            try:
                yield self
            finally:
                self.mark(name, (self.clock() - a) * 1000)

        return timed()

    def finish(self) -> list[tuple[str, str, float]]:
        """Rows (request, stage, ms) with the total, for a table of times."""
        return [(self.request, k, round(v, 1)) for k, v in {**self.times, **self.offsets, "total": (self.clock() - self.began) * 1000}.items()]


def latency(times: DataFrame, first: str = "first", total: str = "total") -> DataFrame:
    """One row: median and 95 % of the time to the first piece and of the whole, by nearest rank, of (request, stage, ms)."""
    p = evaluation.percentiles(times.where(F.col("stage").isin(first, total)), ["stage"], "ms", {"p50": 0.5, "p95": 0.95})
    one = lambda s, c: F.max(F.when(F.col("stage") == s, F.round(c, 1)))
    return p.agg(*(one(s, c).alias(f"{n}_{c}") for n, s in (("first", first), ("total", total)) for c in ("p50", "p95")))


def first_marks(marks: DataFrame) -> DataFrame:
    """(request, stage, ms): of offsets that were marked several times the first."""
    return marks.groupBy("request", "stage").agg(F.min("ms").alias("ms"))
