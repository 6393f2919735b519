"""Progress blocks out of a stream of log lines."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.staging import settle
from ..operators.logs import PROGRESS_KEYS, metrics_of, progress_pairs
from .buckets import Alarms, Cells, by_bucket, in_order, numbered
from .events import BATCH_BYTES, use_rocksdb

# Python workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_BLOCK_SCHEMA = "job_id BIGINT, block BIGINT, " + ", ".join(f"`{k}` STRING" for k in PROGRESS_KEYS)
_KEYS = tuple(PROGRESS_KEYS)
_PROGRESS = _KEYS.index("progress")
#: Codes of a line without a known key, and of the end of a log.
_OTHER, _END = len(_KEYS), len(_KEYS) + 1

#: Silence after which the block number of a log that has ended is forgotten.
MEMORY_MS = 30 * 24 * 60 * 60 * 1000


class BlockAssembler(StatefulProcessor):
    """Holds the open block of each job of a bucket: the last value of each key, and the block's number.

    The end of a log closes its open block and leaves only the block number, for ``memory_ms``.
    With ``tail_ms`` a block also closes when its job is silent for so long (processing time),
    for writers that may die without saying so.
    """

    def __init__(self, tail_ms: int | None, memory_ms: int):
        self.tail_ms, self.memory_ms = tail_ms, memory_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = Cells(handle, "open")
        self.ended = Cells(handle, "ended", self.memory_ms)
        self.alarms = Alarms(handle)

    @staticmethod
    def _frame(jobs: list[int | None], blocks: np.ndarray, values: np.ndarray) -> pd.DataFrame:
        frame = pd.DataFrame(values, columns=list(_KEYS), dtype=object)
        frame.insert(0, "block", blocks.astype(np.int64))
        frame.insert(0, "job_id", pd.array(jobs, dtype="Int64"))
        return frame

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        batch = in_order(rows, "line_no")
        job = batch["job_id"].astype("Int64")
        number, missing = job.fillna(0).to_numpy(np.int64), job.isna().to_numpy()
        begins = np.ones(len(batch), bool)
        begins[1:] = (number[1:] != number[:-1]) | (missing[1:] != missing[:-1])
        first = np.flatnonzero(begins)
        jobs = [None if missing[i] else int(number[i]) for i in first]
        held = self.open.load(jobs, now)
        known_ends = self.ended.load([j for j in jobs if j not in held], now)
        code = batch["code"].to_numpy(np.int64)
        closing = (code == _PROGRESS) | (code == _END)
        # a slot for each block that a job closes, and one for what is open after them
        slot = np.cumsum(closing) - closing + numbered(first, len(batch))
        table = np.full((int(closing.sum()) + len(jobs), len(_KEYS)), None, object)
        start = slot[first]
        end = np.append(start[1:], len(table)) - 1
        block = np.zeros(len(jobs), np.int64)
        for i, j in enumerate(jobs):
            if j in held:
                block[i], table[start[i]] = held[j][1], held[j][3:]
            elif j in known_ends:
                block[i] = known_ends[j][1]
        # the last value of each key of each block: later lines overwrite earlier ones
        known = code < len(_KEYS)
        table[slot[known], code[known]] = batch["value"].to_numpy(object)[known]
        filled = (table != None).any(axis=1)  # noqa: E711
        closed = filled.copy()
        closed[end] = False
        count = np.cumsum(closed) - closed
        owner = numbered(start, len(table))
        numbers = (block - count[start])[owner] + count
        last = np.append(first[1:], len(batch)) - 1
        due, opened, ended = [], {}, {}
        for j, at, line in zip(jobs, end.tolist(), last.tolist()):
            if filled[at]:
                due_ms = None if self.tail_ms is None else now + self.tail_ms
                due += [j]
                opened[j] = (int(numbers[at]), due_ms, *table[at])
            elif code[line] == _END:
                # an ended log leaves its number for a while, a running one keeps it
                if j in held:
                    opened[j] = None
                ended[j] = (int(numbers[at]),)
            else:
                opened[j] = (int(numbers[at]), None, *(None,) * len(_KEYS))
        self.open.store(held, opened, now)
        if ended:
            kept = known_ends | self.ended.load([j for j in ended if j in held], now)
            self.ended.store(kept, ended, now)
        if self.tail_ms is not None and due:
            self.alarms.add({now + self.tail_ms: due})
        yield self._frame([jobs[i] for i in owner[closed]], numbers[closed], table[closed])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, at_ms = timerValues.getCurrentProcessingTimeInMs(), expiredTimerInfo.getExpiryTimeInMs()
        jobs = self.alarms.take(at_ms)
        held = self.open.load(jobs, now)
        tails = {j: held[j] for j in jobs if j in held and held[j][2] == at_ms}
        values = np.array([state[3:] for state in tails.values()], object).reshape(-1, len(_KEYS))
        self.open.store(held, dict.fromkeys(tails), now)
        self.ended.store(self.ended.load(list(tails), now), {j: (state[1] + 1,) for j, state in tails.items()}, now)
        yield self._frame(list(tails), np.array([state[1] for state in tails.values()]), values)

    def close(self) -> None:
        pass


def end_of_logs(lines: DataFrame) -> DataFrame:
    """The end markers of logs that are whole: a null line after the last one of each job."""
    last = F.max("line_no")
    names = {"line_no": (last + 1).alias("line_no"), "line": F.lit(None).cast("string").alias("line")}
    ends = lines.groupBy("job_id").agg(names["line_no"], names["line"])
    return ends.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in lines.schema.fields if f.name in ends.columns])


def read_closed_logs(spark: SparkSession, path: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Stream of ``job_id, line_no, line`` of logs that are written once, one file per job, each
    followed by its end marker. The file name without its ending is the job's number; a
    log has to fit a string."""
    files = spark.readStream.option("wholetext", "true").option("maxBytesPerTrigger", batch_bytes).text(path)
    text = F.regexp_replace("value", r"\n\z", "")
    lines = F.concat(F.split(text, "\n", -1), F.array(F.lit(None).cast("string")))
    job = F.regexp_extract(F.col("_metadata.file_path"), r"([0-9]+)(?:\.[^./]*)?$", 1).cast("bigint")
    return files.select(job.alias("job_id"), F.posexplode(lines).alias("line_no", "line"))


def stream_blocks(lines: DataFrame, tail_ms: int | None = None, memory_ms: int = MEMORY_MS) -> DataFrame:
    """Typed metrics of each block: ``job_id, line_no, line`` lines in, any chunking.

    A null line is the end of its job's log (see ``end_of_logs``, ``read_closed_logs``): it
    closes the open block, so nothing is left when finite input ends. Splitting lines and
    typing values stay in the JVM; Python only folds the values of a job, as arrays.
    """
    use_rocksdb(lines.sparkSession)
    keys = F.array(*[F.lit(k) for k in _KEYS])
    codes = F.array(*[F.lit(c) for c in (_OTHER, *range(len(_KEYS)))])
    place = F.array_position(keys, F.col("key")).cast("int")  # 0: not there
    code = F.coalesce(F.element_at(codes, place + 1), F.lit(_END))
    pairs = settle(progress_pairs(lines, ends=True), {"code": code}).select("job_id", "line_no", "value", "code")
    if tail_ms is None:  # other lines only show that a writer lives
        pairs = pairs.filter(F.col("code") != _OTHER)
    blocks = by_bucket(pairs).transformWithStateInPandas(
        statefulProcessor=BlockAssembler(tail_ms, memory_ms),
        outputStructType=_BLOCK_SCHEMA,
        outputMode="Append",
        timeMode="ProcessingTime",
    )
    values = blocks.select("job_id", "block", F.struct(*PROGRESS_KEYS).alias("v"))
    return values.select(
        "job_id", "block", *[c.alias(n) for n, c in metrics_of(F.col("v")).items()]
    )
