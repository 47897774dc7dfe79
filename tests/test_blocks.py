"""Ordered work along keys, at any number of ranges, against one pass over sorted rows."""

import random

import pytest
from pyspark.sql import functions as F

from tracewright.operators import blocks, detection, tables, usage


def rows_of(seed, n=400):
    """One key has most rows; keys, times and values may be null, times repeat."""
    rng = random.Random(seed)
    return [(k, rng.choice(["hot"] * 8 + ["a", "b", None]), rng.choice([None, *range(60)]), rng.choice([None, 3, -2, -9, 12, 1])) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, k string, t long, v long").repartition(6)


def by_key(rows):
    held = {}
    for r in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0])):
        held.setdefault(r[1], []).append(r)
    return held.values()


@pytest.mark.parametrize("seed", [1, 2])
def test_running_and_clamped_sums(spark, seed):
    rows = rows_of(seed)
    summed, clamped, before = {}, {}, {}
    for run in by_key(rows):
        s = c = 0
        last = None
        for r in run:
            s, c = s + (r[3] or 0), max(0, c + (r[3] or 0))
            summed[r[0]], clamped[r[0]], before[r[0]] = s, c, last
            last = r[3]
    df, along = frame(spark, rows), (("k",), ("t", "id"))
    assert {r.id: r.x for r in blocks.running_sum(df, *along, F.col("v"), "x").collect()} == summed
    assert {r.id: r.x for r in blocks.clamped_sum(df, *along, F.col("v"), "x").collect()} == clamped
    assert {r.id: r.x for r in blocks.previous_row(df, *along, F.col("v"), "x").collect()} == before
    assert {r.id: (r.balance, r.reorder) for r in tables.ledger(df, "k", ("t", "id"), F.col("v"), 4).collect()} == {k: (clamped[k], (v < 0 and clamped[k] < 4) if v is not None else None if clamped[k] < 4 else False) for k, _, _, v in rows}


def test_previous_keeps_rows_without_keys_or_times(spark):
    rows = rows_of(3)
    want = {}
    for i, k, t, _ in rows:
        earlier = [r for r in rows if k is not None and t is not None and r[1] == k and r[2] is not None and r[2] < t]
        last = max(earlier, key=lambda r: (r[2], r[0])) if earlier else None
        want[i] = (last[0], last[3]) if last else (None, None)
    out = usage.previous(frame(spark, rows), "k", "t", "id", "v").collect()
    assert {r.id: (r.prev_id, r.prev_value) for r in out} == want and len(out) == len(rows)


def test_bursts_and_loops(spark):
    rows = rows_of(4)
    runs, loops = [], {}
    for run in by_key(rows):
        last = None
        for r in run:
            if r[2] is not None:
                if last is None or r[2] - last >= 2:
                    runs.append([r[1], r[2], 0])
                runs[-1][2] += 1
                last = r[2]
        for x, y, z in zip(run, run[1:], run[2:]):
            loops[x[1]] = loops.get(x[1], 0) + (x[3] is not None and x[3] == y[3] == z[3])
    df = frame(spark, rows)
    timed = df.withColumn("ts", F.timestamp_seconds("t"))
    got = sorted(((r.k or "", r.s, r.n) for r in usage.bursts(timed, "k", "ts", "2 seconds", 2).select("k", F.unix_seconds("began").alias("s"), "n").collect()))
    assert got == sorted((k or "", t, n) for k, t, n in runs if n >= 2)
    assert {r.k: r.n_loops for r in tables.loops(df, "k", ("t", "id"), "v").collect()} == {k: n for k, n in loops.items() if n}


def test_repeated_sets_reach_back_to_a_message_without_calls(spark):
    said = ["a", "ab", "ba", "b", "aab", None, "a", "a", "", "a", "ab", "a", "ab", "a", "ab"]
    rows = [("s", k, list(c) if c is not None else None) for k, c in enumerate(said)] + [("t", 0, ["a"]), ("t", 1, ["a"]), (None, 0, ["a"]), (None, 1, ["a"]), (None, 2, ["a"])]
    got = {(r.s, r.n) for r in tables.repeated_sets(spark.createDataFrame(rows, "s string, n long, c array<string>"), "s", "n", "c").collect()}
    want = set()
    for s, n, c in rows:
        count = 0
        for _, _, earlier in sorted((r for r in rows if r[0] == s and r[1] < n), key=lambda r: -r[1]):
            if not earlier:
                break
            count += set(earlier) == set(c or [])
        if c and count >= 2:
            want.add((s, n))
    assert got == want and ("s", 4) in want


def test_verdict_of_a_long_answer_with_many_braces(spark):
    deep = '{"is_threat": true, "x": ' + "[" + ", ".join('{"a": "} {", "b": "\\\\d\\""}' for _ in range(25_000)) + "]}"
    text = "{ " * 200 + deep + " } done" + " {}" * 500
    df = spark.createDataFrame([(text,), (deep[:-1],), ('{"is_threat": 1, "re": "\\d \\u00e9 \\u12 \\\\" } }',)], "t string").select(detection.verdict(F.col("t")).alias("v"))
    got = df.select(F.try_variant_get("v", "$.x[24999].b", "string").alias("b"), F.try_variant_get("v", "$.re", "string").alias("re"), F.col("v").isNull().alias("none")).collect()
    assert [(r.b, r.re, r.none) for r in got] == [('\\d"', None, False), (None, None, True), (None, "\\d é \\u12 \\", False)]
