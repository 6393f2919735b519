"""Many jobs of a stream in one group.

A group of its own costs a job tens of milliseconds a micro-batch in Python: frames, Arrow
batches, and a call of a millisecond for each access to state or timers. A bucket of jobs pays
that once, its rows are worked on as arrays, and jobs of neighbouring numbers share a *cell* of
state, which is read and written as one.

Rows reach the state packed, the rows of a bucket in one value: Spark hands a stateful processor
in Python its rows one by one, and that took half of its time.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

# Python workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Groups that jobs are dealt to; fixed for the life of a checkpoint.
BUCKETS = 256
#: A cell holds the jobs whose numbers differ in these low bits only, so 16 at most.
CELL_BITS = 4
#: Rows that a task holds before it packs them.
PACK_ROWS = 1 << 17
_PACKED = "packed_rows"  # Spark renames columns that begin with an underscore
#: Whole numbers stay whole where some are missing.
_WHOLE = {pa.int32(): pd.Int32Dtype(), pa.int64(): pd.Int64Dtype()}


def cell_of(job: str) -> Column:
    return F.shiftright(job, CELL_BITS)


def by_bucket(rows: DataFrame, buckets: int = BUCKETS) -> GroupedData:
    """Rows packed by bucket; ``in_order`` unpacks them."""
    rows = rows.withColumn("__bucket", F.pmod(F.hash(cell_of("job_id")), F.lit(buckets)))
    return rows.mapInArrow(_pack, f"__bucket INT, {_PACKED} BINARY").groupBy("__bucket")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= PACK_ROWS:
            yield _packs(pa.Table.from_batches(held))
            held, count = [], 0
    if count:
        yield _packs(pa.Table.from_batches(held))


def _packs(rows: pa.Table) -> pa.RecordBatch:
    """A row for each bucket: its rows as an Arrow stream."""
    bucket = rows.column("__bucket").to_numpy()
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows.drop_columns(["__bucket"]).take(order), bucket[order]
    first = first_rows(bucket)
    packs = []
    for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(bucket)]):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as stream:
            stream.write_table(rows.slice(lo, hi - lo))
        packs.append(sink.getvalue().to_pybytes())
    return pa.RecordBatch.from_arrays([pa.array(bucket[first], pa.int32()), pa.array(packs, pa.binary())], ["__bucket", _PACKED])


def _unpacked(frame: pd.DataFrame) -> pd.DataFrame:
    if _PACKED not in frame:
        return frame
    tables = [pa.ipc.open_stream(pack).read_all() for pack in frame[_PACKED]]
    return pa.concat_tables(tables).to_pandas(types_mapper=_WHOLE.get)


def in_order(rows: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame:
    """What one micro-batch brings for one bucket, job by job; bounded by the source's byte limit."""
    return pd.concat([_unpacked(frame) for frame in rows], ignore_index=True).sort_values(
        ["job_id", *order], kind="stable", na_position="first", ignore_index=True
    )


def first_rows(key: np.ndarray) -> np.ndarray:
    """Places where the next key begins."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)


def numbered(first: np.ndarray, rows: int) -> np.ndarray:
    """For each row the number of the run that it stands in."""
    return np.repeat(np.arange(len(first)), np.diff(np.append(first, rows)))


class Cells:
    """State of single jobs of a bucket, in cells. With ``ttl_ms`` a job's state is gone when it
    has not been stored for so long.

    A job's state is a tuple of numbers, texts and lists. A cell is stored as JSON, a list of
    job, time stored and state: Spark turns every field of a state in columns over on its own.
    """

    def __init__(self, handle: StatefulProcessorHandle, name: str, ttl_ms: int | None = None):
        self.map = handle.getMapState(name, "cell BIGINT", "jobs STRING", ttl_ms)
        self.ttl_ms = ttl_ms

    def load(self, jobs: list[int | None], now: int) -> dict[int | None, tuple]:
        """States of the cells of these jobs: neighbours too, for ``store`` to keep."""
        out = {}
        for cell in dict.fromkeys(map(self._cell, jobs)):
            held = self.map.getValue((cell,))
            for job, stored_ms, *state in json.loads(held[0]) if held else ():
                if self.ttl_ms is None or stored_ms + self.ttl_ms > now:
                    out[job] = (stored_ms, *state)
        return out

    def store(self, held: dict[int | None, tuple], new: dict[int | None, tuple | None], now: int) -> None:
        """Write the changed jobs, None for no state, with the rest of their cells; ``held``: as loaded."""
        cells = {self._cell(job): [] for job in new}
        after = held | {job: None if state is None else (now, *state) for job, state in new.items()}
        for job, state in after.items():
            if state is not None and self._cell(job) in cells:
                cells[self._cell(job)].append((job, *state))
        for cell, jobs in cells.items():
            if jobs:
                self.map.updateValue((cell,), (json.dumps(jobs),))
            else:
                self.map.removeKey((cell,))

    @staticmethod
    def _cell(job: int | None) -> int | None:
        return None if job is None else job >> CELL_BITS


class Alarms:
    """Deadlines of single jobs of a bucket: a timer of the bucket for each, and the jobs it is for.

    The job's own state names its deadline; one that has moved since is to be passed over.
    """

    def __init__(self, handle: StatefulProcessorHandle):
        self.handle = handle
        self.due = handle.getMapState("due", "at_ms BIGINT", "jobs STRING")

    def add(self, jobs: dict[int, list[int | None]]) -> None:
        for at_ms, new in jobs.items():
            self.due.updateValue((at_ms,), (json.dumps(self._held(at_ms) + new),))
            self.handle.registerTimer(at_ms)

    def take(self, at_ms: int) -> list[int | None]:
        jobs = self._held(at_ms)
        self.due.removeKey((at_ms,))
        return list(dict.fromkeys(jobs))

    def _held(self, at_ms: int) -> list[int | None]:
        held = self.due.getValue((at_ms,))
        return json.loads(held[0]) if held else []
