"""Chunked scans against a plain model, with keys that span many chunks."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from reelyard.operators.running import numbered, previous, running


def sample(seed: int, rows: int = 400):
    rng = random.Random(seed)
    data, position = [], {"hot": 0, "a": 0, "b": 0}
    for _ in range(rows):
        key = rng.choice(["hot"] * 6 + ["a", "b"])
        position[key] += rng.randint(1, 9)  # gaps leave chunks empty
        value = None if rng.random() < 0.2 else rng.randint(-50, 50)
        data.append((key, position[key], value))
    rng.shuffle(data)
    return data


def test_running_matches_a_sequential_scan(spark):
    for seed in (1, 2, 3):
        data = sample(seed)
        df = spark.createDataFrame(data, "k string, o bigint, v int")
        scans = {
            "s": ("sum", F.col("v").cast("bigint"), True),
            "before": ("max", F.col("v"), False),
            "low": ("min", F.col("v"), True),
            "n": ("count", F.lit(1), True),
        }
        got = {
            (r.k, r.o): (r.s, r.before, r.low, r.n)
            for r in running(df, ["k"], ["o"], scans, size=7).collect()
        }
        state: dict = {}
        for k, o, v in sorted(data, key=lambda r: (r[0], r[1])):
            s, top, low, n = state.get(k, (None, None, None, 0))
            before = top
            if v is not None:
                s = v if s is None else s + v
                top = v if top is None else max(top, v)
                low = v if low is None else min(low, v)
            state[k] = (s, top, low, n + 1)
            assert got[(k, o)] == (s, before, low, n + 1)
        assert len(got) == len(data)


def test_previous_and_numbered_cross_chunks(spark):
    data = sample(4)
    df = spark.createDataFrame(data, "k string, o bigint, v int")
    rows = {(r.k, r.o): r for r in previous(df, ["k"], ["o"], {"last_o": "o", "last_v": "v"}, size=5).collect()}
    ranks = {(r.k, r.o): r.rank for r in numbered(df, ["k"], ["o"], "rank", size=5).collect()}
    seen: dict = {}
    for k, o, v in sorted(data, key=lambda r: (r[0], r[1])):
        last = seen.get(k)
        assert (rows[(k, o)].last_o, rows[(k, o)].last_v) == ((last[1], last[2]) if last else (None, None))
        seen[k] = (last[0] + 1 if last else 1, o, v)
        assert ranks[(k, o)] == seen[k][0]


def test_hot_key_is_spread_over_tasks(spark):
    """No window of the plan may be partitioned by the key alone over the full rows."""
    df = spark.range(1000).select(F.lit("hot").alias("k"), F.col("id").alias("o"))
    out = running(df, ["k"], ["o"], {"n": ("count", F.lit(1), True)}, size=10)
    per_chunk = out.groupBy(F.floor(F.col("o") / 10).alias("c")).agg(F.max("n").alias("top"))
    assert {r.c: r.top for r in per_chunk.collect()} == {c: (c + 1) * 10 for c in range(100)}


def test_null_keys_and_null_order_values_are_kept(spark):
    data = [(None, 1, 5), (None, 2, 7), ("a", None, 1), ("a", 3, 2), ("a", 30, 4), (None, 40, 1)]
    df = spark.createDataFrame(data, "k string, o bigint, v bigint")
    scans = {"s": ("sum", F.col("v"), True), "n": ("count", F.lit(1), False)}
    got = {(r.k, r.o): (r.s, r.n) for r in running(df, ["k"], ["o"], scans, size=7).collect()}
    assert got == {(None, 1): (5, 0), (None, 2): (12, 1), (None, 40): (13, 2), ("a", None): (1, 0), ("a", 3): (3, 1), ("a", 30): (7, 2)}
    before = {(r.k, r.o): r.b for r in previous(df, ["k"], ["o"], {"b": "v"}, size=7).collect()}
    assert before == {(None, 1): None, (None, 2): 5, (None, 40): 7, ("a", None): None, ("a", 3): 1, ("a", 30): 2}
