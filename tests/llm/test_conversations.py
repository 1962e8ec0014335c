import random

import pytest
from pyspark.sql import functions as F

from vellum.llm import conversations as C

T = "id long, session_id string, role string, content string, at double"


def frame(spark, rows):
    return spark.createDataFrame(rows, T).select("id", "session_id", "role", "content", F.lit(None).cast("string").alias("source_docs"), F.timestamp_seconds("at").cast("timestamp_ntz").alias("created_at"), F.lit("x").alias("who"))


def brute(rows):
    """The definition, session by session."""
    seen, s = {}, {}
    for i, sid, role, text, at in rows:
        seen.setdefault(i, (i, (sid or "").strip().lower(), (role or "").strip().lower(), text, at))
    for i, sid, role, text, at in seen.values():
        if sid:
            s.setdefault(sid, []).append((i, role, text, at))
    out, whole = {}, {}
    for sid, ms in s.items():
        ts = [m for m in ms if m[1] != "system" and (m[2] or "").strip(" \n\t​ ")]
        ts.sort(key=lambda m: (m[3] is None, m[3] or 0, m[0]))
        who = lambda r: 1 if r in ("user", "human") else 2 if r in ("model", "bot", "assistant") else 0
        kept = [m for k, m in enumerate(ts) if not (k and who(m[1]) == who(ts[k - 1][1]) and " ".join(m[2].split()) == " ".join(ts[k - 1][2].split()) and m[3] is not None and ts[k - 1][3] is not None and m[3] - ts[k - 1][3] <= 5)]
        w = [who(m[1]) for m in kept]
        if not kept:
            out[sid] = "empty"
        elif any(m[3] is None for m in kept) or 0 in w or w[0] == 2 or any(a == b == 2 for a, b in zip(w, w[1:])):
            out[sid] = "broken"
        elif any(a == 1 and b != 2 for a, b in zip(w, [*w[1:], 0])):
            out[sid] = "missing_reply"
        else:
            whole[sid] = [m[2] for m in kept]
    return out, whole


def test_kahn_orders_by_priority_and_leaves_cycles():
    assert C.kahn([3, 1, 2], [(0, 1)]) == ([2, 0, 1], [])
    order, left = C.kahn([1, 2, 3, 4], [(0, 1), (1, 2), (2, 1), (2, 3)])
    assert order == [0] and sorted(left) == [1, 2, 3]
    assert C.kahn([], []) == ([], [])


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_against_the_definition_with_a_large_session(spark, parts):
    random.seed(parts)
    rows = []
    for i in range(400):
        big = random.random() < 0.4
        rows.append((i, "BIG" if big else random.choice([f"s{k}" for k in range(40)] + [" S1 ", None, " "]), random.choice(["user", "model"] * 8 + ["system", "Bot ", "??", None]), random.choice(["a", "b", "c  d", "c d", "", "​", None, "e"] if not big else ["a", "b"]), random.choice([None] + [float(i // 2)] * 30)))
    for k in range(30):
        for j in range(4):
            rows.append((1000 + 4 * k + j, f"w{k}", ["user", "model"][j % 2], f"t{j}", float(j * 10)))
    rows += [(5000 + j, "long", ["human", "assistant"][j % 2], f"m{j}", float(j)) for j in range(120)]
    rows += [random.choice(rows) for _ in range(40)]
    want, whole = brute(rows)
    df = frame(spark, rows)
    assert {(r.session_id, r.defect) for r in C.dropped(df, parts).collect()} == set(want.items())
    got = {}
    for r in C.conversations(df, parts).orderBy("session_id", "turn").collect():
        got.setdefault(r.session_id, []).append((r.turn, r.content))
    assert {k: [c for _, c in v] for k, v in got.items()} == whole
    assert all([t for t, _ in v] == list(range(1, len(v) + 1)) for v in got.values())


def test_repeats_within_five_seconds_are_one_turn_across_segments(spark):
    rows = [(1, "s", "user", "q", 0.0), (2, "s", "user", "q", 4.0), (3, "s", "model", "a", 9.0), (4, "t", "user", "q", 0.0), (5, "t", "user", "q", 6.0), (6, "t", "model", "a", 9.0)]
    for parts in (1, 6):
        assert {(r.session_id, r.defect) for r in C.dropped(frame(spark, rows), parts).collect()} == {("t", "missing_reply")}


def test_empty_table(spark):
    df = frame(spark, [(1, "s", "user", "x", 0.0)]).limit(0)
    assert C.dropped(df).count() == 0 and C.conversations(df).count() == 0
