"""Jobs that run by a clock or on demand, at most one of a name at a time, and models that stand in for each other."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from vellum.operators.changes import TRANSIENT


def running(spark: SparkSession, name: str) -> StreamingQuery | None:
    """The active query of a name."""
    return next((q for q in spark.streams.active if q.name == name and q.isActive), None)


def start_once(spark: SparkSession, name: str, start: Callable[[], StreamingQuery]) -> tuple[StreamingQuery, bool]:
    """The running query of a name, or the one that start() begins; whether it was begun now. Spark itself refuses a second query of the name if two callers race."""
    q = running(spark, name)
    if q is not None:
        return q, False
    try:
        return start(), True
    except Exception:
        q = running(spark, name)
        if q is None:
            raise
        return q, False


def every(spark: SparkSession, seconds: float, job: Callable[[int], object], state: str, name: str = "scheduled") -> tuple[StreamingQuery, bool]:
    """Runs job(number of the run) every so many seconds; a run that takes longer delays the next one, so runs never overlap."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    begin = lambda: ticks.writeStream.foreachBatch(lambda _, n: job(n) and None).option("checkpointLocation", state).queryName(name).trigger(processingTime=f"{seconds} seconds").start()
    return start_once(spark, name, begin)


def may_pass(error: BaseException) -> bool:
    """Whether a failed call is worth another try, or another model."""
    return any(t in str(error).lower() for t in TRANSIENT)


def failover(models: Iterable[Callable], tries: int = 3, wait: float = 10.0, most: float = 120.0, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """One model of several: a call goes to the first; after an error that may pass it is tried again after wait, 2 wait, … seconds (at most `most`), then the next model is asked. Other errors go to the next model at once. The last error is raised."""
    models = list(models)

    def call(*args, **kw):
        error: BaseException | None = None
        for m in models:
            for n in range(tries):
                try:
                    return m(*args, **kw)
                except Exception as e:  # whatever a model raises
                    error = e
                    if not may_pass(e):
                        break
                    if n + 1 < tries:
                        sleep(min(most, wait * 2**n))
        raise error if error else ValueError("no models")

    return call
