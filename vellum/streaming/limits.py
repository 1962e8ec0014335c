"""Streams of events: the sliding log of a rate limit as keyed state, stage times in windows, change of a store.

Late data: events older than the watermark are dropped by windows; the rate limit works in order
of arrival within a batch sorted by time, as its decisions can't be taken back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DECISION = "key string, ts timestamp, accepted boolean, retry_after double"


def rate_limit(events: DataFrame, limit: int, seconds: int = 60) -> DataFrame:
    """(key, ts, accepted, retry_after) of a stream (key string, ts timestamp): a hit is accepted if fewer than `limit` accepted ones lie within the last `seconds`. State is the accepted times within the window, at most `limit` a key; it ends when the window has passed."""
    reach = seconds * 1_000_000

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = list(state.get[0]) if state.exists else []
        f = pd.concat(list(frames)).sort_values("ts", kind="stable")
        out = []
        for ts in f["ts"]:
            t = ts.value // 1000
            log = [x for x in log if t - x <= reach]
            ok = len(log) < limit
            out.append((key[0], ts, ok, None if ok else (reach - (t - log[0])) / 1e6))
            if ok:
                log.append(t)
        state.update((log,))
        state.setTimeoutDuration(seconds * 2000)
        yield pd.DataFrame(out, columns=["key", "ts", "accepted", "retry_after"])

    return events.groupBy("key").applyInPandasWithState(run, DECISION, "log array<bigint>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def stage_windows(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, stage, n, mean, p50, p95, max) of a stream (ts, stage, ms) in tumbling windows, with late events allowed for."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "stage")
    a = g.agg(F.count("*").alias("n"), F.avg("ms").alias("mean"), F.approx_percentile("ms", [0.5, 0.95], 1000).alias("p"), F.max("ms").alias("max"))
    return a.select(F.col("w.start").alias("start"), "stage", "n", F.round("mean", 1).alias("mean"), F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"), "max")


def frames(raw: DataFrame) -> DataFrame:
    """(kind, text) of a stream of server-sent text: frames parted by empty lines, their tag, or delta for untagged ones."""
    f = raw.select(F.explode(F.split("value", r"\n\n")).alias("f")).where(F.trim("f") != "")
    body = F.regexp_replace("f", r"^data: ?", "")
    tag = F.lower(F.regexp_extract(body, r"^\[([A-Z_]+)\]", 1))
    return f.select(F.when(tag == "", "delta").otherwise(tag).alias("kind"), F.regexp_replace(body, r"^\[[A-Z_]+\]", "").alias("text"))


class Watcher:
    """Tells whether a table changed since it was last looked at; the first look only records."""

    def __init__(self):
        self.seen: tuple | None = None

    def changed(self, df: DataFrame, *cols: str) -> bool:
        from vellum.operators.cache import fingerprint

        now = tuple(fingerprint(df.select(F.xxhash64(*(cols or df.columns)).alias("h"))).first())
        before, self.seen = self.seen, now
        return before is not None and before != now
