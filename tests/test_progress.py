"""Progress goldens and plain models."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from reelyard import dims
from reelyard.operators import progress as ops

EVENTS = "event_id bigint, job_id bigint, sequence bigint, ts timestamp, status string, progress_tenths bigint, elapsed_cs bigint"


def make(spark, rows):
    return spark.createDataFrame(rows, EVENTS)


def random_events(seed, jobs=6, steps=120, clock_back=False):
    from datetime import datetime, timedelta

    rng, rows, event = random.Random(seed), [], 0
    for job in range(jobs):
        clock = 0
        for n in range(1, (steps * 4 if job == 0 else steps) + 1):
            event += 1
            clock += rng.choice([0, 0, 30, 150, 900])
            if clock_back and rng.random() < 0.1:
                clock = max(0, clock - 700)
            roll = rng.random()
            status = "completed" if roll < 0.004 else "failed" if roll < 0.008 else rng.choice(["queued", "processing", "encoding"])
            progress = min(1000, max(0, n * 3 + rng.randint(-40, 60)))
            rows.append((event, job, n, datetime(2024, 1, 1) + timedelta(seconds=event), status, progress, clock))
    rng.shuffle(rows)
    return rows


def model(rows):
    """Sequential model: normalised progress and remaining seconds per event."""
    out, jobs = {}, {}
    for event, job, seq, _, status, tenths, clock in sorted(rows, key=lambda r: (r[1], r[2])):
        s = jobs.setdefault(job, dict(p=0, end=False, lp=None, lt=None, recent=[], smooth=None, shown=None))
        if s["end"]:
            continue
        s["p"] = 1000 if status == "completed" else max(s["p"], min(990, max(0, tenths)))
        p, t, now = s["p"] / 10, clock / 100, None
        if 0 < p < 100 and t > 0:
            if s["lp"] is not None and (p <= s["lp"] or t <= s["lt"]):
                now = None if s["smooth"] is None else max(0, math.floor(s["smooth"] + 0.5))
            else:
                s["lp"], s["lt"] = p, t
                s["recent"] = (s["recent"] + [t / p * (100 - p)])[-8:]
                if len(s["recent"]) >= 3 and p >= 1 and t >= 2:
                    weights = range(1, len(s["recent"]) + 1)
                    mean = sum(r * w for r, w in zip(s["recent"], weights)) / sum(weights)
                    s["smooth"] = mean if s["smooth"] is None else s["smooth"] * 0.65 + mean * 0.35
                    now = max(0, math.floor(s["smooth"] + 0.5))
        s["shown"] = 0 if status == "completed" else now if now is not None else s["shown"]
        s["end"] = status in ("completed", "failed", "cancelled")
        out[(job, seq)] = (s["p"], s["shown"])
    return out


def test_progress_and_remaining_time_match_the_model(spark):
    for seed, clock_back in ((1, False), (2, False), (3, True), (4, True)):
        rows = random_events(seed, clock_back=clock_back)
        normal = ops.normalize_progress(make(spark, rows), size=16)
        got = {(r.job_id, r.sequence): (r.progress, r.remaining_s) for r in ops.remaining_time(normal).collect()}
        assert got == model(rows)


def test_eta_waits_for_samples_and_ignores_rewinds(spark):
    from datetime import datetime

    t = datetime(2024, 1, 1)
    rows = [(1, 1, 1, t, "processing", 50, 200), (2, 1, 2, t, "processing", 100, 400),
            (3, 1, 3, t, "processing", 200, 800), (4, 1, 4, t, "processing", 190, 900)]
    normal = ops.normalize_progress(make(spark, rows))
    got = [r.remaining_s for r in ops.remaining_time(normal).orderBy("sequence").collect()]
    assert got[:2] == [None, None] and 30 <= got[2] <= 40 and got[3] == got[2]
    r = spark.range(1).select(
        ops.simple_remaining(F.lit(25.0), F.lit(30.0)).alias("a"), ops.simple_remaining(F.lit(0.0), F.lit(30.0)).alias("b"),
        ops.simple_remaining(F.lit(100.0), F.lit(30.0)).alias("c"),
    ).first()
    assert tuple(r) == (90, None, None)


def test_overall_progress(spark):
    df = spark.createDataFrame(
        [(1, 100.0, "completed", 1000, 600), (1, 50.0, "processing", 2000, None), (1, 0.0, "pending", 1000, None),
         (2, float("nan"), "failed", None, None), (2, 150.0, "finalizing", None, None)],
        "batch_id int, progress double, status string, original_size bigint, output_size bigint",
    )
    got = {r.batch_id: r for r in ops.overall_progress(df).collect()}
    assert (got[1].completed_files, got[1].total_files, got[1].progress, got[1].saved_bytes) == (1, 3, 50.0, 400)
    assert (got[2].progress, got[2].original_bytes) == (49.5, 0)


def test_transitions(spark):
    from datetime import datetime

    t = datetime(2024, 1, 1)
    path = ["pending", "processing", "processing", "failed", "pending", "analyzing", "encoding", "completed", "processing"]
    rows = [(i, 1, i + 1, t, s, 0, 0) for i, s in enumerate(path)]
    bad = ops.illegal_transitions(make(spark, rows), dims.transition_edges(spark), size=2)
    assert {(r.from_status, r.to_status) for r in bad.collect()} == {("encoding", "completed"), ("completed", "processing")}


def test_replay_stops_after_the_first_terminal_event(spark):
    from datetime import datetime

    t = datetime(2024, 1, 1)
    rows = [(i, j, i, t, "failed" if i == 4 else "processing", 0, 0) for j in (1, 2, 3) for i in range(1, 7)]
    cursors = spark.createDataFrame([(1, "1:2"), (2, None), (3, "job:4")], "job_id bigint, last_event_id string")
    got = sorted((r.job_id, r.sequence) for r in ops.replay(make(spark, rows), cursors).collect())
    assert got == [(1, 3), (1, 4), (2, 1), (2, 2), (2, 3), (2, 4), (3, 5), (3, 6)]


def test_stage_inference_matches_the_rule(spark):
    labels = dims.STAGE_LABELS["video"]
    texts = ["ファイルを確認", "動画をエンコード中", "検証中", "待機", "音声を結合", "デコード待ち", "サムネイル", "設定を読込"]
    import re

    rng, rows, want, previous = random.Random(5), [], [], 0
    for n in range(1, 200):
        stage, progress = rng.choice(texts), float(rng.choice([10, 50, 99, 99.5]))
        exact = next((i for i, x in enumerate(labels) if x in stage or stage in x), None)
        pattern = next((i for i, p in enumerate(dims.STAGE_PATTERNS) if re.search(p, stage)), None)
        if exact is not None:
            previous = exact
        elif pattern is not None:
            previous = min(len(labels) - 1, max(previous, pattern))
        elif progress >= 99:
            previous = len(labels) - 1
        rows.append((1, n, stage, progress))
        want.append(previous)
    df = spark.createDataFrame(rows, "job_id int, sequence bigint, stage string, progress double")
    got = ops.infer_stage(df, labels, size=9).orderBy("sequence").collect()
    assert [r.stage_index for r in got] == want


def test_stage_timeline_matches_the_step_list(spark):
    from datetime import datetime, timedelta

    rng = random.Random(11)
    labels = tuple("abcde")
    rows, want = [], {}
    for job in range(12):
        steps = [dict(status="pending", start=None, done=None) for _ in labels]
        for n in range(1, 25):
            ts = datetime(2024, 1, 1) + timedelta(seconds=n)
            at = rng.randint(0, 4)
            status = rng.choice(["queued", "processing", "processing", "encoding"])
            if n == 24:
                status = rng.choice(["completed", "failed", "cancelled", "processing", "queued"])
            rows.append((job, n, ts, status, at))
            new = []
            for i, old in enumerate(steps):
                waiting = status in ("pending", "queued")
                if status == "completed" or i < at:
                    new.append(dict(status="completed", start=old["start"] or ts, done=old["done"] or ts))
                elif i == at:
                    stop = status in ("failed", "cancelled")
                    new.append(dict(
                        status=status if stop else "pending" if waiting else "processing",
                        start=old["start"] or (None if waiting else ts), done=ts if stop else None,
                    ))
                else:
                    new.append(dict(status="pending", start=None, done=None))
            steps = new
        for i, s in enumerate(steps):
            want[(job, i)] = (s["status"], s["start"], s["done"])
    df = spark.createDataFrame(rows, "job_id int, sequence bigint, ts timestamp, status string, stage_index int")
    got = {(r.job_id, r.stage_index): (r.stage_status, r.started_at, r.completed_at) for r in ops.stage_timeline(df, labels).collect()}
    assert got == want


def test_log_feed_ignores_out_of_order_events(spark):
    rng = random.Random(7)
    order = list(range(1, 120))
    for i in range(0, 110, 6):
        a, b = i, i + rng.randint(1, 5)
        order[a], order[b] = order[b], order[a]
    rows = [(1, 1000 + s, s, "processing", i + 1) for i, s in enumerate(order)]
    df = spark.createDataFrame(rows, "job_id int, event_id bigint, sequence bigint, status string, arrival bigint")
    want, top = set(), 0
    for s in order:
        if s > top:
            want.add(1000 + s)
            top = s
    assert {r.event_id for r in ops.log_feed(df, size=8).collect()} == want


def test_status_mapping(spark):
    df = spark.createDataFrame([("AI高画質化", 5.0), ("ffprobeで解析", 5.0), ("動画を圧縮", 5.0), ("完了", 5.0), ("待機", 99.0), ("待機", 5.0)], "stage string, p double")
    got = [r.s for r in df.select(ops.status_from_stage(F.col("stage"), F.col("p")).alias("s")).collect()]
    assert got == ["enhancing", "analyzing", "encoding", "finalizing", "finalizing", "processing"]
    coarse = spark.createDataFrame([("completed",), ("uploading",), ("encoding",), ("failed",)], "s string")
    assert [r.c for r in coarse.select(ops.coarse_status(F.col("s")).alias("c")).collect()] == ["complete", "queued", "running", "error"]
