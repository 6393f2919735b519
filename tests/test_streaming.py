"""Streams against batch results, and timers."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pandas as pd
import pyarrow as pa


from reelyard.catalogue.streams import feed
from reelyard.streaming import blocks, buckets, events, tables

COLUMNS = "event_id bigint, job_id bigint, sequence bigint, ts timestamp, status string, progress_tenths bigint, elapsed_cs bigint, output_size bigint"


def at(minutes):
    return datetime(2024, 1, 1) + timedelta(minutes=minutes)


def track(spark, home, slices, **limits):
    parts = [spark.createDataFrame(rows, COLUMNS) for rows in slices]
    feed(parts, f"{home}/in", lambda s: tables.append_table(events.track_jobs(s, **limits), f"{home}/out", f"{home}/cp"))
    out = spark.read.schema(events.TRACK_SCHEMA).parquet(f"{home}/out")
    return sorted(((r.job_id, r.kind, r.sequence, r.status, r.progress) for r in out.collect()), key=str)


def test_tracker_rejects_late_and_freezes(spark, tmp_path):
    got = track(spark, tmp_path, [
        [(1, 1, 1, at(0), "processing", 100, 100, None), (2, 1, 2, at(1), "encoding", 50, 200, 500)],
        [(3, 1, 2, at(2), "encoding", 300, 300, None), (4, 1, 3, at(3), "completed", 0, 400, None), (5, 1, 4, at(4), "processing", 0, 500, None)],
    ])
    assert got == sorted([
        (1, "event", 1, "processing", 100), (1, "event", 2, "encoding", 100), (1, "late", 2, "encoding", None),
        (1, "event", 3, "completed", 1000), (1, "late", 4, "processing", None),
    ], key=str)


def test_events_days_late_count_and_broken_ones_are_rejected(spark, tmp_path):
    got = track(spark, tmp_path, [
        [(9, 2, 1, at(9000), "processing", 10, 100, None), (1, 1, 1, at(8000), "processing", 100, 100, None)],
        # days behind everything seen so far, yet next in sequence
        [(2, 1, 2, at(0), "completed", 100, 200, None), (3, 2, None, at(1), "processing", 1, 1, None), (4, None, 1, at(1), "queued", 1, 1, None)],
        [(5, 2, 2, None, "encoding", None, None, None), (6, 2, 3, at(2), None, 20, 5, None)],
    ])
    assert got == sorted([
        (2, "event", 1, "processing", 10), (1, "event", 1, "processing", 100), (1, "event", 2, "completed", 1000),
        (2, "rejected", None, "processing", None), (None, "rejected", 1, "queued", None),
        (2, "event", 2, "encoding", 10), (2, "rejected", 3, None, None),
    ], key=str)


def test_silent_jobs_are_told_once_and_state_expires(spark, tmp_path):
    tick = lambda n: [(100 + n, 3, n, at(n), "processing", n, 100 * n, None)]
    got = track(spark, tmp_path, [
        [(1, 1, 1, at(0), "processing", 100, 100, None), (2, 2, 1, at(0), "completed", 0, 100, None)],
        tick(1), tick(2), tick(3),
        # job 2's state is gone, but not its end; job 1 goes on where it was
        [(5, 2, 2, at(62), "processing", 30, 100, None), (6, 1, 1, at(63), "processing", 900, 100, None), (7, 1, 2, at(64), "encoding", 200, 300, None)],
    ], stall_ms=1, run_ms=7_200_000, retention_ms=1)
    assert [r for r in got if r[0] == 2] == [(2, "event", 1, "completed", 1000), (2, "late", 2, "processing", None)]
    assert [r for r in got if r[0] == 1] == [
        (1, "event", 1, "processing", 100), (1, "event", 2, "encoding", 200), (1, "late", 1, "processing", None), (1, "stalled", 1, "processing", 100),
    ]


def test_running_too_long_is_reported(spark, tmp_path):
    slices = [[(i, 1, i + 1, at(5 * i), "processing", 10 * i, 100 * i + 100, None)] for i in range(2)]
    slices.append([(99, 2, 1, at(40), "processing", 10, 100, None)])
    got = track(spark, tmp_path, slices, stall_ms=3_600_000, run_ms=1, retention_ms=1_800_000)
    assert (1, "stalled", 2, "processing", 10) in got


def test_progress_lines_and_duplicates(spark, tmp_path):
    (tmp_path / "in").mkdir()
    row = {"event_id": 1, "job_id": 7, "sequence": 1, "ts": "2024-01-01T00:00:00Z", "status": "queued", "progress_tenths": 0, "elapsed_cs": 0}
    lines = [json.dumps(row), "", "   ", json.dumps(row), "not json", json.dumps(dict(row, event_id=2, sequence=2)), json.dumps(dict(row, sequence=None))]
    (tmp_path / "in" / "a.ndjson").write_text("\n".join(lines))
    stream = events.ingest(events.stream_progress(spark, str(tmp_path / "in")))
    tables.append_table(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    kept = spark.read.schema(events.INGEST_SCHEMA).parquet(str(tmp_path / "out"))
    assert sorted((r.event_id, r.kind) for r in kept.collect()) == [(1, "event"), (1, "late"), (2, "event")]
    tables.append_table(events.stream_rejects(spark, str(tmp_path / "in")), str(tmp_path / "bad"), str(tmp_path / "cp2")).awaitTermination()
    assert sorted(r.value for r in spark.read.parquet(str(tmp_path / "bad")).collect()) == sorted([lines[4], lines[6]])


LINE = "job_id bigint, line_no bigint, line string"


def block_rows(spark, home, slices, **options):
    parts = [spark.createDataFrame(rows, LINE) for rows in slices]
    feed(parts, f"{home}/in", lambda s: tables.append_table(blocks.stream_blocks(s, **options), f"{home}/out", f"{home}/cp"))
    return sorted((r.job_id, r.block, r.frame, r.fps, r.state) for r in spark.read.parquet(f"{home}/out").collect())


def test_open_block_is_held_between_batches_and_ends_with_its_log(spark, tmp_path):
    got = block_rows(spark, tmp_path, [
        [(1, 1, "frame=1"), (1, 2, "progress=continue"), (1, 3, "frame=2"), (2, 1, "frame=9"), (2, 2, None), (3, 1, None)],
        [(1, 4, "fps=5"), (1, 5, "progress=end"), (1, 6, "frame=3"), (1, 7, "frame=4"), (1, 8, "noise"), (1, 9, "other=1"), (1, 10, None)],
    ])
    assert got == [(1, 0, 1.0, None, "continue"), (1, 1, 2.0, 5.0, "end"), (1, 2, 4.0, None, None), (2, 0, 9.0, None, None)]


def test_a_log_that_goes_on_after_its_end_keeps_its_numbers(spark, tmp_path):
    got = block_rows(spark, tmp_path, [
        [(1, 1, "frame=1"), (1, 2, None)], [(1, 3, "fps=2"), (1, 4, "progress=continue"), (1, 5, "fps=3")], [(1, 6, None), (1, 7, "frame=8")],
    ])
    assert got == [(1, 0, 1.0, None, None), (1, 1, None, 2.0, "continue"), (1, 2, None, 3.0, None)]


def test_silent_writers_may_be_timed_out(spark, tmp_path):
    got = block_rows(spark, tmp_path, [[(1, 1, "frame=1")], [(2, 1, "progress=end")], [(1, 2, "fps=2"), (1, 3, None)]], tail_ms=1)
    assert [r for r in got if r[0] == 1] == [(1, 0, 1.0, None, None), (1, 1, None, 2.0, None)]


def test_whole_log_files_need_no_later_row(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "7.log").write_text("frame=1\nfps=3\nprogress=continue\nframe=2\n")
    (tmp_path / "logs" / "8.log").write_text("frame=5\r\nprogress=end\r\n")
    stream = blocks.stream_blocks(blocks.read_closed_logs(spark, str(tmp_path / "logs")))
    tables.append_table(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = sorted((r.job_id, r.block, r.frame, r.fps, r.state) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(7, 0, 1.0, 3.0, "continue"), (7, 1, 2.0, None, None), (8, 0, 5.0, None, "end")]


LATEST = "job_id BIGINT, sequence BIGINT, status STRING"


def test_latest_state_survives_a_repeated_batch(spark, tmp_path):
    table = tables.latest_table(spark, str(tmp_path), LATEST, 2)
    first = spark.createDataFrame([(1, 1, "queued"), (2, 1, "queued"), (1, 2, "processing")], LATEST)
    second = spark.createDataFrame([(1, 3, "completed")], LATEST)
    for _ in range(2):
        table.write(first, 0)
    for _ in range(2):
        table.write(second, 1)
    table.write(spark.createDataFrame([(3, 1, "queued")], LATEST), 2)
    got = sorted((r.job_id, r.sequence, r.status) for r in tables.latest_state(spark, str(tmp_path), LATEST).collect())
    assert got == [(1, 3, "completed"), (2, 1, "queued"), (3, 1, "queued")]


def test_folders_stay_bounded_and_a_pinned_reader_unharmed(spark, tmp_path):
    table = tables.latest_table(spark, str(tmp_path), LATEST, 3)
    count = lambda kind: len([p for p in (tmp_path / kind).iterdir() if p.is_dir()])
    assert table.read().count() == 0
    for i in range(8):
        table.write(spark.createDataFrame([(i % 4, i, "s")], LATEST), i)
    with table.pinned() as rows:
        for i in range(8, 20):
            table.write(spark.createDataFrame([(i % 4, i, "s")], LATEST), i)
        assert sorted((r.job_id, r.sequence) for r in rows.collect()) == [(0, 4), (1, 5), (2, 6), (3, 7)]
        assert count("batches") > 9
    for i in range(20, 50):
        table.write(spark.createDataFrame([(i % 4, i, "s")], LATEST), i)
        assert count("batches") <= 15 and count("snapshots") <= 6
    assert count("batches") <= 6 and count("snapshots") <= 2 and count("manifests") <= 2 and count("pins") == 0
    assert sorted((r.job_id, r.sequence) for r in table.read().collect()) == [(0, 48), (1, 49), (2, 46), (3, 47)]


def test_totals_are_added_up_from_changes(spark, tmp_path):
    slices = [
        [(1, 1, 1, at(0), "processing", 100, 100, 5), (2, 2, 1, at(0), "processing", 300, 100, 5)],
        [(3, 1, 2, at(1), "encoding", 50, 200, 500), (4, 2, 2, at(1), "completed", 0, 300, 700), (5, 1, 1, at(2), "processing", 900, 1, 1)],
        [(6, 1, 3, at(3), "encoding", 450, 300, 600), (7, 3, 1, at(3), "failed", 20, 1, None), (8, 2, 3, at(4), "processing", 10, 1, 1)],
    ]
    parts = [spark.createDataFrame(rows, COLUMNS) for rows in slices]
    home = str(tmp_path)

    def start(stream):
        rows = events.track_jobs(stream, retention_ms=10**9).selectExpr("*", "job_id div 3 as batch_id", "1000 * job_id as original_size")
        return tables.stream_overall(rows, f"{home}/t", f"{home}/cp", 2)

    feed(parts, f"{home}/in", start)
    got = sorted(tuple(r) for r in tables.live_overall(spark, f"{home}/t").collect())
    assert got == [(0, 1, 2, 72.5, 2000, 700, 1300), (1, 0, 1, 2.0, 0, 0, 0)]


def test_a_job_that_was_forgotten_is_not_counted_again(spark, tmp_path):
    tick = lambda n: [(100 + n, 9, n, at(n), "processing", n, 100 * n, None)]
    parts = [[(1, 1, 1, at(0), "processing", 300, 100, None)], tick(1), tick(2), tick(3), [(2, 1, 2, at(9), "encoding", 200, 300, None)]]
    parts = [spark.createDataFrame(rows, COLUMNS) for rows in parts]
    feed(parts, f"{tmp_path}/in", lambda s: tables.append_table(
        events.track_jobs(s, stall_ms=1, run_ms=7_200_000, retention_ms=1), f"{tmp_path}/out", f"{tmp_path}/cp"))
    rows = spark.read.schema(events.TRACK_SCHEMA).parquet(f"{tmp_path}/out").where("job_id = 1 and kind = 'event'").collect()
    assert sorted((r.sequence, r.progress, r.progress_delta, r.first) for r in rows) == [(1, 300, 300, True), (2, 300, 0, False)]


class Calls:
    """A state handle in memory that counts accesses."""

    def __init__(self):
        self.maps, self.timers, self.calls = {}, [], 0

    def getMapState(self, name, *_):
        outer, held = self, self.maps.setdefault(name, {})

        class Map:
            def getValue(self, key):
                outer.calls += 1
                return held.get(key)

            def updateValue(self, key, value):
                outer.calls += 1
                held[key] = value

            def removeKey(self, key):
                outer.calls += 1
                held.pop(key, None)

        return Map()

    def registerTimer(self, at_ms):
        self.calls += 1
        self.timers.append(at_ms)


class Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentProcessingTimeInMs(self):
        return self.ms

    getExpiryTimeInMs = getCurrentProcessingTimeInMs


def group(processor, rows, columns, now=0):
    return next(processor.handleInputRows((0,), iter([pd.DataFrame(rows, columns=columns)]), Now(now)))


EVENT_COLUMNS = [c.split()[0] for c in COLUMNS.split(", ")]


def test_jobs_of_a_group_share_frames_and_state_calls():
    jobs = 320
    for make in (lambda: events.JobTracker(10, 1000, 10, 1000), lambda: events.SequenceFilter(1000)):
        processor, handle = make(), Calls()
        processor.init(handle)
        for n in (1, 2):
            sent = [(2 * j + n, j, s, at(n), "processing", 10 * s, 100 * s, None) for j in range(jobs) for s in (n, 1)]
            out = group(processor, sent, EVENT_COLUMNS)
            assert sorted(out.loc[out["kind"] == "event", ["job_id", "sequence"]].itertuples(index=False, name=None)) == [(j, n) for j in range(jobs)]
            assert (out["kind"] == "late").sum() == jobs
        assert handle.calls < jobs / 2


def test_lines_of_many_logs_are_folded_at_once():
    keys, jobs = list(blocks._KEYS), 320
    lines = [(j, n, v, keys.index(k)) for j in range(jobs) for n, (k, v) in enumerate((("frame", str(j)), ("progress", "continue"), ("fps", "5")))]
    processor, handle = blocks.BlockAssembler(None, 1000), Calls()
    processor.init(handle)
    columns = ["job_id", "line_no", "value", "code"]
    out = group(processor, lines, columns)
    assert list(zip(out["job_id"], out["block"], out["frame"])) == [(j, 0, str(j)) for j in range(jobs)]
    out = group(processor, [(j, 9, None, blocks._END) for j in range(jobs)], columns)
    assert list(zip(out["job_id"], out["block"], out["fps"])) == [(j, 1, "5") for j in range(jobs)]
    assert handle.calls < jobs / 2 and not handle.maps["open"]


def test_deadlines_of_neighbours_are_kept_apart():
    processor, handle = events.JobTracker(10, 10_000, 5, 50), Calls()
    processor.init(handle)
    send = lambda job, n, status, now: group(processor, [(n, job, n, at(n), status, 10, 10, None)], EVENT_COLUMNS, now)
    ring = lambda now: [(r.job_id, r.kind) for r in next(processor.handleExpiredTimer((0,), Now(now), Now(now))).itertuples()]
    send(1, 1, "processing", 0)
    send(2, 1, "completed", 0)
    send(1, 2, "processing", 3)  # the deadline moves from 10 to 13
    assert ring(5) == [] and ring(10) == [] and ring(13) == [(1, "stalled")]
    assert list(send(2, 2, "processing", 14)["kind"]) == ["late"]  # only the end of job 2 is left
    assert ring(55) == [] and list(send(2, 2, "processing", 56)["kind"]) == ["event"]
    assert list(send(1, 2, "processing", 57)["kind"]) == ["late"]


def test_whole_numbers_stay_exact_beside_missing_ones(spark, tmp_path):
    big = 2**53 + 1
    sent = [(big + 2 * i, 1, big + 2 * i, at(i), "processing", 1, 1, None) for i in range(3)] + [(7, 1, None, at(9), "processing", 1, 1, None)]
    feed([spark.createDataFrame(sent, COLUMNS)], f"{tmp_path}/in", lambda s: tables.append_table(events.ingest(s), f"{tmp_path}/out", f"{tmp_path}/cp"))
    got = spark.read.schema(events.INGEST_SCHEMA).parquet(f"{tmp_path}/out").collect()
    assert sorted((r.kind, r.event_id, r.sequence or 0) for r in got) == [*(("event", big + 2 * i, big + 2 * i) for i in range(3)), ("rejected", 7, 0)]
    assert {r.ts for r in got} == {at(0), at(1), at(2), at(9)}


def test_partitions_of_state_do_not_follow_those_of_the_session(spark, tmp_path):
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, "40")
    try:
        got = track(spark, tmp_path, [[(1, 1, 1, at(0), "processing", 100, 100, None)]])
        assert spark.conf.get(key) == "40"
    finally:
        spark.conf.set(key, before)
    assert got == [(1, "event", 1, "processing", 100)]
    assert len([p for p in (tmp_path / "cp" / "state" / "0").iterdir() if p.name.isdigit()]) == tables.STATE_PARTITIONS


class Done:
    def awaitTermination(self):
        pass


def test_jobs_that_share_a_cell_are_fed_in_one_file(spark, tmp_path):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        feed([spark.createDataFrame([(j, j, 1, at(0), "queued", 0, 0, None) for j in range(64)], COLUMNS)], f"{tmp_path}/in", lambda _: Done())
    finally:
        spark.conf.set(key, before)
    found = spark.read.parquet(f"{tmp_path}/in").selectExpr("job_id div 16 as cell", "_metadata.file_path as file").distinct().collect()
    assert len(found) == 4 and len({r.file for r in found}) > 1


def test_a_processor_gets_a_row_for_each_bucket():
    rows = pa.table({
        "job_id": pa.array([3, 1, None, 1], pa.int64()), "sequence": pa.array([1, 2, 5, 1], pa.int64()),
        "status": ["a", "b", None, "c"], "__bucket": pa.array([9, 4, 4, 4], pa.int32()),
    })
    packs = pd.concat([b.to_pandas() for b in buckets._pack(iter(rows.to_batches(max_chunksize=3)))])
    assert list(packs["__bucket"]) == [4, 9]
    frames = [buckets.in_order(iter([packs[packs["__bucket"] == b]]), "sequence") for b in (4, 9)]
    assert frames[0].astype(object).where(frames[0].notna(), None).values.tolist() == [[None, 5, None], [1, 1, "c"], [1, 2, "b"]]
    assert frames[1].values.tolist() == [[3, 1, "a"]]
