"""Streams of progress events: source, ingest, per-job tracking."""

from __future__ import annotations

import math
import sys
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .buckets import Alarms, Cells, by_bucket, first_rows, in_order, numbered

# Python workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

EVENT_SCHEMA = (
    "event_id BIGINT, job_id BIGINT, sequence BIGINT, ts TIMESTAMP, status STRING,"
    " progress_tenths BIGINT, elapsed_cs BIGINT, output_size BIGINT"
)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# --- fixed values: retention, stall and running limits ---------------------------
RETENTION_MS = 30 * 60 * 1000
STALL_MS = 10 * 60 * 1000
MAX_RUN_MS = 2 * 60 * 60 * 1000
ETA_SAMPLES, ETA_MINIMUM = 8, 3

#: How long the last sequence of a job outlives its state, so that no late event revives it.
MEMORY_MS = 30 * 24 * 60 * 60 * 1000
#: Bytes of input files in a micro-batch; bounds what one busy job brings at once.
BATCH_BYTES = 64 << 20


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed Python state needs the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _parsed_lines(spark: SparkSession, path: str, batch_bytes: int) -> DataFrame:
    lines = spark.readStream.option("maxBytesPerTrigger", batch_bytes).text(path)
    lines = lines.filter(F.trim("value") != "")
    return lines.select("value", F.from_json("value", EVENT_SCHEMA).alias("e"))


def _usable(e: str) -> F.Column:
    return F.coalesce(
        F.col(f"{e}job_id").isNotNull() & F.col(f"{e}sequence").isNotNull() & F.col(f"{e}status").isNotNull(),
        F.lit(False),
    )


def _usable_rows(batch: pd.DataFrame) -> np.ndarray:
    return (batch["job_id"].notna() & batch["sequence"].notna() & batch["status"].notna()).to_numpy()


def stream_progress(spark: SparkSession, path: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Usable events from newline-delimited JSON files; blank lines are dropped.

    An event needs a job, a sequence and a status; see ``stream_rejects`` for the others.
    """
    return _parsed_lines(spark, path, batch_bytes).filter(_usable("e.")).select("e.*")


def stream_rejects(spark: SparkSession, path: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """The lines that ``stream_progress`` can't use, as they are."""
    return _parsed_lines(spark, path, batch_bytes).filter(~_usable("e.")).select("value")


def _times(values: pd.Series) -> pd.Series:
    return values if pd.api.types.is_datetime64_any_dtype(values) else pd.to_datetime(values)


INGEST_SCHEMA = (
    "job_id BIGINT, kind STRING, event_id BIGINT, sequence BIGINT, ts TIMESTAMP, status STRING,"
    " progress_tenths BIGINT, elapsed_cs BIGINT, output_size BIGINT"
)
_INGEST = [c.split()[0] for c in INGEST_SCHEMA.split(",")]


class SequenceFilter(StatefulProcessor):
    """Marks the events of each job of a bucket whose sequence is above all before it; state: one number a job."""

    def __init__(self, memory_ms: int):
        self.memory_ms = memory_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = Cells(handle, "last", self.memory_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = in_order(rows, "sequence", "event_id")
        usable = _usable_rows(batch)
        at = np.flatnonzero(usable)
        kind = np.where(usable, "late", "rejected").astype(object)
        if len(at):
            job, sequence = (batch[c].iloc[at].to_numpy(np.int64) for c in ("job_id", "sequence"))
            first = first_rows(job)
            jobs, tops = job[first].tolist(), sequence[np.append(first[1:], len(at)) - 1].tolist()
            now = timerValues.getCurrentProcessingTimeInMs()
            known = self.last.load(jobs, now)
            held = [known.get(j) for j in jobs]
            new = np.concatenate([[True], sequence[1:] != sequence[:-1]])
            new[first] = True
            seen, last = np.array([h is not None for h in held]), np.array([h[1] if h else 0 for h in held], np.int64)
            of = numbered(first, len(at))
            kind[at[new & (~seen[of] | (sequence > last[of]))]] = "event"
            self.last.store(known, {j: (max(top, h[1]) if h else top,) for j, top, h in zip(jobs, tops, held)}, now)
        batch["kind"] = kind
        yield batch[_INGEST]

    def close(self) -> None:
        pass


def ingest(events: DataFrame, memory_ms: int = MEMORY_MS) -> DataFrame:
    """Every delivered event once, marked ``event``, ``late`` (its sequence is not above the
    job's last one, so repeats too) or ``rejected`` (no job, sequence or status).

    There is no watermark: nothing is dropped however late it comes. A job that is silent for
    ``memory_ms`` is forgotten.
    """
    use_rocksdb(events.sparkSession)
    return by_bucket(events).transformWithStateInPandas(
        statefulProcessor=SequenceFilter(memory_ms), outputStructType=INGEST_SCHEMA,
        outputMode="Append", timeMode="ProcessingTime",
    )


TRACK_SCHEMA = (
    "job_id BIGINT, kind STRING, sequence BIGINT, ts TIMESTAMP, status STRING, progress BIGINT,"
    " remaining_s BIGINT, output_size BIGINT, estimated_output_size BIGINT,"
    " progress_delta BIGINT, first BOOLEAN"
)
_COLUMNS = [c.split()[0] for c in TRACK_SCHEMA.split(",")]
_FIELDS = (
    "sequence", "progress", "status", "ts_ms", "first_ms", "due_ms", "told", "remaining", "output_size",
    "estimated", "eta_p", "eta_t", "smooth", "recent",
)
_TERMINAL = ("completed", "failed", "cancelled")


def _remaining(state: dict, tenths: np.ndarray, elapsed_cs: np.ndarray) -> list[int | None]:
    """Feed observations to the smoothed estimate; the value that each shows, or None.

    Only observations ahead of all before them in both progress and time are folded; the
    arrays tell which could be.
    """
    shown: list[int | None] = [None] * len(tenths)
    p, t = tenths / 10.0, elapsed_cs / 100.0
    for i in np.flatnonzero((p > 0) & (p < 100) & (t > 0)):
        at_p, at_t = float(p[i]), float(t[i])
        if state["eta_p"] is None or (at_p > state["eta_p"] and at_t > state["eta_t"]):
            state["eta_p"], state["eta_t"] = at_p, at_t
            state["recent"] = (state["recent"] + [at_t / at_p * (100.0 - at_p)])[-ETA_SAMPLES:]
            n = len(state["recent"])
            if n < ETA_MINIMUM or at_p < 1 or at_t < 2:
                continue
            total = 0.0
            for weight, value in enumerate(state["recent"], 1):
                total += value * weight
            mean = total / (n * (n + 1) / 2)
            old = state["smooth"]
            state["smooth"] = mean if old is None else old * 0.65 + mean * 0.35
        if state["smooth"] is not None:
            shown[i] = max(0, math.floor(state["smooth"] + 0.5))
    return shown


def _carried(values: np.ndarray, known: np.ndarray, first: np.ndarray, before: list) -> tuple[np.ndarray, np.ndarray]:
    """Each value, or where it is not known the one before it of the same job, and whether there is one.

    ``first``: where the rows of each job begin. ``before``: what each job had, or None.
    """
    of = numbered(first, len(values))
    place = np.maximum.accumulate(np.where(known, np.arange(len(values)), -1))
    inside = place >= first[of]
    held, had = np.array([b or 0 for b in before], np.int64), np.array([b is not None for b in before], bool)
    return np.where(inside, values[place], held[of]), inside | had[of]


class JobTracker(StatefulProcessor):
    """State of each job of a bucket: last sequence, progress, estimate, sizes, deadline.

    Every input row gives one output row. An event whose sequence is not above the last one,
    or that follows a terminal event, is ``late`` and changes nothing; one without job,
    sequence or status is ``rejected``. Timers run on processing time: a job that is silent
    or runs for too long is ``stalled`` once; a finished or stalled job leaves only its last
    sequence, status and progress when its retention has passed, and that for ``memory_ms``.
    ``progress_delta`` is what an event adds to the job's progress and ``first`` whether it is
    the job's first, so that totals over jobs can be kept by adding up rows.
    """

    def __init__(self, stall_ms: int, run_ms: int, retention_ms: int, memory_ms: int):
        self.stall_ms, self.run_ms = stall_ms, run_ms
        self.retention_ms, self.memory_ms = retention_ms, memory_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.jobs = Cells(handle, "jobs")
        self.alarms = Alarms(handle)

    @staticmethod
    def _state(held: tuple | None) -> dict:
        """A job's state; one that is new, or only remembered, has no ``first_ms``."""
        if held is None:
            return dict.fromkeys(_FIELDS) | {"progress": 0, "recent": []}
        state = dict(zip(_FIELDS, held[1:]))
        state["recent"] = list(state["recent"] or [])
        return state

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        batch = in_order(rows, "sequence", "event_id")
        usable = _usable_rows(batch)
        at = np.flatnonzero(usable)
        job = batch["job_id"].iloc[at].to_numpy(np.int64)
        jobs = job[first_rows(job)].tolist()
        held = self.jobs.load(jobs, now)
        states = [self._state(held.get(j)) for j in jobs]
        at, of = self._new_events(states, batch, at, numbered(first_rows(job), len(job)))
        kind = np.where(usable, "late", "rejected").astype(object)
        kind[at] = "event"
        out = pd.DataFrame(
            {"job_id": batch["job_id"].astype("Int64"), "kind": kind, "sequence": batch["sequence"].astype("Int64"),
             "ts": _times(batch["ts"]), "status": batch["status"]}
        )
        begun = of[first_rows(of)].tolist()
        self._advance([states[i] for i in begun], batch.iloc[at], out, at, first_rows(of))
        due, stored = defaultdict(list), {}
        for i in begun:
            state, before = states[i], states[i]["due_ms"]
            state["told"] = False
            if state["first_ms"] is None:
                state["first_ms"] = now
            limit = min(now + self.stall_ms, max(state["first_ms"] + self.run_ms, now + 1))
            state["due_ms"] = now + self.retention_ms if state["status"] in _TERMINAL else limit
            if state["due_ms"] != before:
                due[state["due_ms"]].append(jobs[i])
            stored[jobs[i]] = tuple(state[f] for f in _FIELDS)
        self.jobs.store(held, stored, now)
        self.alarms.add(due)
        yield out[_COLUMNS]

    @staticmethod
    def _new_events(states: list[dict], batch: pd.DataFrame, at: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the events above all sequences of their job before them, up to its first
        terminal one, and the numbers of their jobs."""
        sequence = batch["sequence"].iloc[at].to_numpy(np.int64)  # ascending in each job
        fresh = np.array([s["sequence"] is None for s in states], bool)
        last = np.array([s["sequence"] or 0 for s in states], np.int64)
        live = np.array([s["status"] not in _TERMINAL for s in states], bool)
        new = np.ones(len(at), bool)
        new[1:] = (sequence[1:] != sequence[:-1]) | (of[1:] != of[:-1])
        new &= live[of] & (fresh[of] | (sequence > last[of]))
        at, of = at[new], of[new]
        ends = batch["status"].iloc[at].isin(_TERMINAL).to_numpy()
        before = np.cumsum(ends) - ends
        first = first_rows(of)
        kept = before == before[first][numbered(first, len(of))]
        return at[kept], of[kept]

    @staticmethod
    def _advance(states: list[dict], events: pd.DataFrame, out: pd.DataFrame, at: np.ndarray, first: np.ndarray) -> None:
        """Feed new events to the states of their jobs and fill their rows of ``out``.

        ``first``: where the events of each job begin.
        """
        of, ends = numbered(first, len(at)), np.append(first[1:], len(at))
        done = (events["status"] == "completed").to_numpy()
        told = events["progress_tenths"]
        told = told.where(told.notna(), 0).to_numpy(np.int64).clip(0, 990)
        before = np.array([s["progress"] for s in states], np.int64)
        highest = pd.Series(told).groupby(of).cummax().to_numpy(np.int64)
        progress = np.where(done, 1000, np.maximum(highest, before[of]))
        previous = np.roll(progress, 1)
        previous[first] = before
        elapsed = events["elapsed_cs"].to_numpy(float, na_value=np.nan)
        shown = []
        for state, lo, hi in zip(states, first.tolist(), ends.tolist()):
            shown += _remaining(state, progress[lo:hi], elapsed[lo:hi])
        seconds = np.where(done, 0, np.array([-1 if r is None else r for r in shown], np.int64))
        held = lambda field: [s[field] for s in states]
        remaining, has_remaining = _carried(seconds, seconds >= 0, first, held("remaining"))
        known = events["output_size"].notna().to_numpy()
        sizes, sized = _carried(events["output_size"].where(known, 0).to_numpy(np.int64), known, first, held("output_size"))
        share = np.where(progress > 0, progress, 1000) / 1000
        whole = np.maximum(sizes, np.floor(sizes / share + 0.5).astype(np.int64))
        estimated, has_estimate = _carried(whole, sized & (progress > 0), first, held("estimated"))
        for column, values, there in (
            ("progress", progress, None), ("remaining_s", remaining, has_remaining), ("output_size", sizes, sized),
            ("estimated_output_size", estimated, has_estimate), ("progress_delta", progress - previous, None),
        ):
            full, missing = np.zeros(len(out), np.int64), np.ones(len(out), bool)
            full[at], missing[at] = values, False if there is None else ~there
            out[column] = pd.arrays.IntegerArray(full, missing)
        begins, missing = np.zeros(len(out), bool), np.ones(len(out), bool)
        begins[at[first]], missing[at] = [s["sequence"] is None for s in states], False
        out["first"] = pd.arrays.BooleanArray(begins, missing)
        times = _times(events["ts"])
        ms = times.to_numpy("datetime64[ms]").astype(np.int64)
        ms, timed = _carried(ms, times.notna().to_numpy(), first, held("ts_ms"))
        sequence, status = events["sequence"].to_numpy(), events["status"].to_numpy(object)
        for state, i in zip(states, (ends - 1).tolist()):
            state.update(
                progress=int(progress[i]), sequence=int(sequence[i]), status=status[i],
                remaining=int(remaining[i]) if has_remaining[i] else None, output_size=int(sizes[i]) if sized[i] else None,
                estimated=int(estimated[i]) if has_estimate[i] else None, ts_ms=int(ms[i]) if timed[i] else None,
            )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, at_ms = timerValues.getCurrentProcessingTimeInMs(), expiredTimerInfo.getExpiryTimeInMs()
        out, due, stored = [], defaultdict(list), {}
        jobs = self.alarms.take(at_ms)
        held = self.jobs.load(jobs, now)
        for job in jobs:
            state = self._state(held.get(job))
            if state["due_ms"] != at_ms:
                continue
            if state["first_ms"] is None:
                stored[job] = None
                continue
            if state["status"] in _TERMINAL or state["told"]:
                left = {f: state[f] for f in ("sequence", "status", "progress")}
                state = dict.fromkeys(_FIELDS) | left | {"due_ms": now + self.memory_ms}
            else:
                ts = None if state["ts_ms"] is None else pd.Timestamp(state["ts_ms"], unit="ms", tz="UTC")
                out.append(
                    (job, "stalled", state["sequence"], ts, state["status"], state["progress"],
                     state["remaining"], state["output_size"], state["estimated"], None, None)
                )
                state.update(told=True, due_ms=now + self.retention_ms)
            due[state["due_ms"]].append(job)
            stored[job] = tuple(state[f] for f in _FIELDS)
        self.jobs.store(held, stored, now)
        self.alarms.add(due)
        yield self._frame(out)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=_COLUMNS)
        for column in ("sequence", "progress", "remaining_s", "output_size", "estimated_output_size", "job_id", "progress_delta"):
            frame[column] = frame[column].astype("Int64")
        frame["ts"] = pd.to_datetime(frame["ts"])
        frame["first"] = frame["first"].astype("boolean")
        return frame

    def close(self) -> None:
        pass


def track_jobs(
    events: DataFrame,
    stall_ms: int = STALL_MS,
    run_ms: int = MAX_RUN_MS,
    retention_ms: int = RETENTION_MS,
    memory_ms: int = MEMORY_MS,
) -> DataFrame:
    """Track every job of an event stream; see ``JobTracker`` for the rows it emits.

    Events are judged by their sequence alone, however late they come: no watermark drops
    any. Limits are in milliseconds of processing time.
    """
    use_rocksdb(events.sparkSession)
    return by_bucket(events).transformWithStateInPandas(
        statefulProcessor=JobTracker(stall_ms, run_ms, retention_ms, memory_ms),
        outputStructType=TRACK_SCHEMA,
        outputMode="Append",
        timeMode="ProcessingTime",
    )
