"""Conversations from message rows.

The reply graph of a session: messages carry no pointer to the message they answer, so a turn
answers what was said at the last time before its own. The turns of one time are tied: edges go
from them to a node of their time, and from there to all turns of the next time. Kahn's algorithm
takes the free turns in order of (created_at, id), which settles the ties; a turn without a time
has nothing to answer to but itself, and is left over as a cycle.

A session may hold any share of all rows. Rows are therefore range-partitioned by (session,
time, id), which cuts a large session into segments in several tasks; each segment is ordered
and summarised alone, and only the summaries, at most one per task and session, are joined.

Defined results: a null or blank session id belongs to no conversation; rows with an equal id
are one message (a null id is a message of its own for each distinct content); a system row or
a row with nothing visible is no turn; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.text import trimmed, visible

#: Names of the speakers after trimming and lower case.
USER_NAMES = ["user", "human", "student", "customer", "client", "me", "person"]
MODEL_NAMES = ["model", "assistant", "bot", "ai", "chatbot", "agent", "gpt"]
SYSTEM_NAMES = ["system", "developer"]
REPEAT_SECONDS = 5.0


def session_key(c: Column) -> Column:
    """Session ids as they are compared: lower case without surrounding blanks, blank as null."""
    c = F.lower(trimmed(c))
    return F.when(c != "", c)


def speaker(c: Column) -> Column:
    """user, model, system or null of a role."""
    c = F.lower(trimmed(c))
    return F.when(c.isin(USER_NAMES), "user").when(c.isin(MODEL_NAMES), "model").when(c.isin(SYSTEM_NAMES), "system")


def kahn(keys: list, edges: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Topological order of nodes 0..n-1, the smallest key first among those that are free, and the nodes left over on or behind cycles."""
    n = len(keys)
    waits, after = [0] * n, [[] for _ in range(n)]
    for a, b in edges:
        after[a].append(b)
        waits[b] += 1
    free = [(keys[i], i) for i in range(n) if not waits[i]]
    heapq.heapify(free)
    order: list[int] = []
    while free:
        _, i = heapq.heappop(free)
        order.append(i)
        for j in after[i]:
            waits[j] -= 1
            if not waits[j]:
                heapq.heappush(free, (keys[j], j))
    done = set(order)
    return order, [i for i in range(n) if i not in done]


def turns_of(messages: DataFrame) -> DataFrame:
    """Rows (sid, id, who, said, at, turn) of all distinct messages of a conversation; who is 1 for user, 2 for model, 0 for unknown."""
    who = speaker(F.col("role"))
    m = messages.select(session_key(F.col("session_id")).alias("sid"), "id", who.alias("w"), "content", F.col("created_at").cast("timestamp").alias("at")).where("sid is not null")
    m = m.withColumn("_own", F.when(F.col("id").isNull(), F.sha2(F.to_json(F.struct("sid", "content", "at", "w")), 256))).dropDuplicates(["id", "_own"]).drop("_own")
    turn = visible(F.col("content")) & ~F.coalesce(F.col("w") == "system", F.lit(False))
    return m.select("sid", "id", F.when(F.col("w") == "user", 1).when(F.col("w") == "model", 2).otherwise(0).cast("tinyint").alias("who"), F.when(turn, F.col("content")).alias("content"), "at", turn.alias("turn"))


def _cut(t: DataFrame, parts: int | None) -> DataFrame:
    """t range-partitioned by session, time and id: a session of any size is spread over tasks."""
    by = ["sid", F.col("at").asc_nulls_last(), F.col("id").asc_nulls_last()]
    return (t.repartitionByRange(parts, *by) if parts else t.repartitionByRange(*by)).sortWithinPartitions(*by)


def _order(at: np.ndarray, ids: np.ndarray) -> tuple[list[int], list[int]]:
    """Kahn's order of one segment: at in microseconds, the least integer for no time."""
    none = np.iinfo(np.int64).min
    n, times = len(at), np.unique(at[at != none])
    group = np.searchsorted(times, at)
    keys = [*zip(at.tolist(), ids.tolist(), range(n)), *((t, np.inf, n + g) for g, t in enumerate(times.tolist()))]
    edges = []
    for i, g in enumerate(group.tolist()):
        if at[i] == none:
            edges.append((i, i))
        else:
            edges.append((i, n + g))  # all turns of a time come before its node
            if g:
                edges.append((n + g - 1, i))
    order, left = kahn(keys, edges)
    return [i for i in order if i < n], [i for i in left if i < n]


SEGMENT = "sid string, part int, n bigint, has_turn boolean, bad boolean, model_twice boolean, unanswered boolean, first_who int, last_who int, first_said bigint, last_said bigint, first_at bigint, last_at bigint, kept bigint"
TURN = "sid string, part int, pos bigint, who int, id bigint, content string, at timestamp, said bigint, repeat boolean, bad boolean, twice boolean, unanswered boolean"


def _blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole segments: the rows of one session in this task; all short ones of a batch together."""
    held: list[pd.DataFrame] = []
    for f in frames:
        if not len(f):
            continue
        k = int((f["sid"] == f["sid"].iloc[-1]).to_numpy().argmax())  # where the last session begins
        if held and (k or held[-1]["sid"].iloc[-1] != f["sid"].iloc[0]):
            yield pd.concat([*held, f.iloc[:k]], ignore_index=True)
            held = []
        elif k:
            yield f.iloc[:k].reset_index(drop=True)
        held.append(f.iloc[k:])
    if held:
        yield pd.concat(held, ignore_index=True)


def _ordered(frame: pd.DataFrame) -> Iterator[tuple[str, pd.DataFrame, list[int], list[int]]]:
    at = frame["at"].to_numpy("datetime64[us]").astype(np.int64)  # NaT is the least integer
    frame = frame.assign(us=at)
    ids = frame["id"].fillna(-1).to_numpy(np.int64)
    sid = frame["sid"].to_numpy(object)
    turn = frame["turn"].to_numpy(bool)
    edge = np.flatnonzero(np.r_[True, sid[1:] != sid[:-1], True])
    for a, b in zip(edge, edge[1:]):
        k = np.flatnonzero(turn[a:b]) + a
        order, left = _order(at[k], ids[k])
        yield sid[a], frame, k[order].tolist(), k[left].tolist()


def _segments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyspark import TaskContext

    part, gap = TaskContext.get().partitionId(), int(REPEAT_SECONDS * 1e6)
    for block in _blocks(frames):
        who, said, out = block["who"].to_numpy(np.int64), block["said"].fillna(0).to_numpy(np.int64), []
        for sid, f, order, left in _ordered(block):
            if not order:
                out.append((sid, part, 0, bool(left), bool(left), False, False, None, None, None, None, None, None, 0))
                continue
            us = f["us"].to_numpy()
            o = np.array(order)
            w, s, u = who[o], said[o], us[o]
            again = np.r_[False, (w[1:] == w[:-1]) & (s[1:] == s[:-1]) & (u[1:] - u[:-1] <= gap)]
            fresh = ~again[1:]
            out.append((sid, part, len(o), True, bool(left) or bool((w == 0).any()), bool(((w[:-1] == 2) & (w[1:] == 2) & fresh).any()), bool(((w[:-1] == 1) & (w[1:] != 2) & fresh).any()), int(w[0]), int(w[-1]), int(s[0]), int(s[-1]), int(u[0]), int(u[-1]), int((~again).sum())))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SEGMENT.split(", ")]).astype({c: "Int64" for c in ("first_who", "last_who", "first_said", "last_said", "first_at", "last_at")})


def said(c: Column) -> Column:
    """What makes a message a repetition of the one before: the same content, character by character."""
    return F.when(c.isNotNull(), F.xxhash64(c))


def segments(messages: DataFrame, parts: int | None = None) -> DataFrame:
    """One row per session and task; contents travel as hashes, of which only neighbours in a session are compared."""
    t = turns_of(messages).withColumn("said", said(F.col("content"))).drop("content")
    return _cut(t, parts).mapInPandas(_segments, SEGMENT)


def judge(segs: DataFrame) -> DataFrame:
    """(session_id, n_turns, defect) of every conversation; defect is null for a whole one."""
    gap = int(REPEAT_SECONDS * 1e6)
    g = segs.groupBy("sid").agg(F.max("has_turn").alias("has_turn"), F.max("bad").alias("bad"), F.max("model_twice").alias("mt"), F.max("unanswered").alias("un"), F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct("part", "first_who", "last_who", "first_said", "last_said", "first_at", "last_at", "kept")))).alias("s"))
    pairs = "transform(sequence(1, size(s) - 1), i -> struct(s[i - 1] as a, s[i] as b))"
    again = f"p.a.last_who = p.b.first_who and p.a.last_said = p.b.first_said and p.b.first_at - p.a.last_at <= {gap}"
    g = g.withColumn("p", F.expr(f"if(size(s) > 1, {pairs}, array())"))
    g = g.withColumn("mt", F.expr(f"mt or exists(p, p -> p.a.last_who = 2 and p.b.first_who = 2 and not ({again}))")).withColumn("un", F.expr(f"un or exists(p, p -> p.a.last_who = 1 and p.b.first_who <> 2 and not ({again}))"))
    n = F.expr(f"cast(aggregate(s, 0L, (x, y) -> x + y.kept) - size(filter(p, p -> {again})) as bigint)")
    defect = F.when(~F.col("has_turn"), "empty").when(F.col("bad") | F.col("mt") | (F.expr("s[0].first_who") == 2), "broken").when(F.col("un") | (F.expr("element_at(s, -1).last_who") == 1), "missing_reply")
    return g.select(F.col("sid").alias("session_id"), n.alias("n_turns"), defect.alias("defect"))


def _rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The turns of each segment with their place in it; turns that are left over have none."""
    from pyspark import TaskContext

    part, gap = TaskContext.get().partitionId(), int(REPEAT_SECONDS * 1e6)
    for block in _blocks(frames):
        rows, over, size, f = [], [], [], block
        for _, f, order, left in _ordered(block):
            rows += order
            over += left
            size.append(len(order))
        x, y, size = f.iloc[rows], f.iloc[over], np.array(size, np.int64)
        n = len(x)
        start, end = np.zeros(n, bool), np.zeros(n, bool)
        start[np.cumsum(np.r_[0, size])[:-1][size > 0]] = True
        end[np.cumsum(size)[size > 0] - 1] = True
        who, us, hashes = x["who"].to_numpy(np.int64), x["us"].to_numpy(), x["said"].to_numpy()
        same = lambda a: np.r_[False, a[1:] == a[:-1]] if n else np.zeros(0, bool)
        again = ~start & same(who) & same(hashes) & (np.diff(us, prepend=us[:1]) <= gap)
        twice = ~start & same(who) & (who == 2) & ~again
        unanswered = np.r_[(who[:-1] == 1) & (who[1:] != 2) & ~again[1:], [False]] if n else np.zeros(0, bool)
        pos = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
        out = pd.DataFrame({"sid": x["sid"].to_numpy(object), "part": part, "pos": pos, "who": who, "id": x["id"].to_numpy(), "content": x["content"].to_numpy(object), "at": x["at"].to_numpy(), "said": hashes, "repeat": again, "bad": who == 0, "twice": twice, "unanswered": unanswered & ~end})
        rest = pd.DataFrame({"sid": y["sid"].to_numpy(object), "part": part, "pos": None, "who": y["who"].to_numpy(np.int64), "id": y["id"].to_numpy(), "content": y["content"].to_numpy(object), "at": y["at"].to_numpy(), "said": y["said"].to_numpy(), "repeat": False, "bad": True, "twice": False, "unanswered": False})
        yield (pd.concat([out, rest]) if len(y) else out).astype({"pos": "Int64", "who": "int32"})


def conversations(messages: DataFrame, parts: int | None = None) -> DataFrame:
    """The turns (session_id, turn, speaker, content, created_at) of every whole conversation, turn from 1. Turns are ordered and written once; conversations are judged from what was written."""
    from pyspark.sql import Window as W

    from vellum.session import checkpointed

    rows = checkpointed(_cut(turns_of(messages).where("turn").withColumn("said", said(F.col("content"))), parts).mapInPandas(_rows, TURN))
    one = F.when(F.col("pos").isNotNull(), F.struct("who", "said", F.unix_micros("at").alias("at")))
    g = rows.groupBy("sid", "part").agg(F.min_by(one, "pos").alias("a"), F.max_by(one, "pos").alias("b"), F.count("pos").alias("n"), F.max("bad").alias("bad"), F.max("twice").alias("model_twice"), F.max("unanswered").alias("unanswered"), F.count_if(~F.col("repeat") & F.col("pos").isNotNull()).alias("kept"))
    ends = [F.col(f"{x}.{c}").alias(f"{y}_{c}") for c in ("who", "said", "at") for x, y in (("a", "first"), ("b", "last"))]
    segs = g.select("sid", "part", "n", F.lit(True).alias("has_turn"), "bad", "model_twice", "unanswered", *ends, "kept")
    fine = judge(segs).where("defect is null").select(F.col("session_id").alias("sid"))
    w = W.partitionBy("sid").orderBy("part")  # at most one row per task
    before = F.lag("b").over(w)
    again = F.coalesce((before.who == F.col("a.who")) & (before.said == F.col("a.said")) & (F.col("a.at") - before.at <= int(REPEAT_SECONDS * 1e6)), F.lit(False))
    edge = g.withColumn("again", again).select("sid", "part", "again", (F.sum(F.col("kept") - F.col("again").cast("int")).over(w) - F.col("kept") + F.col("again").cast("int")).alias("base"))
    rows = rows.join(fine, "sid", "left_semi").join(edge, ["sid", "part"])
    rows = rows.where(~F.col("repeat") & ~(F.col("again") & (F.col("pos") == 0)))
    within = W.partitionBy("sid", "part").orderBy("pos")
    return rows.select(F.col("sid").alias("session_id"), (F.col("base") + F.row_number().over(within)).cast("bigint").alias("turn"), F.when(F.col("who") == 1, "user").otherwise("model").alias("speaker"), "content", F.col("at").alias("created_at"))


def dropped(messages: DataFrame, parts: int | None = None) -> DataFrame:
    """(session_id, defect) of every conversation that is left out: empty, broken or missing_reply."""
    return judge(segments(messages, parts)).where("defect is not null").select("session_id", "defect")
