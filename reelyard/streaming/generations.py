"""Tables that grow by micro-batches and are compacted, for readers that come at any time.

A micro-batch adds a folder named after its id. Every so many batches all rows are resolved
into a snapshot, and a manifest makes that *generation* the current one: its snapshot and the
batches after it. Readers that take long pin the generation they read. What lies below the
oldest generation that is pinned, or is one of the last two, is removed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove

#: A pin older than this is of a reader that has died.
PIN_HOURS = 24


class Generations:
    """``path`` holds ``batches/batch=<id>``, ``snapshots/upto=<id>``, ``manifests/upto=<id>`` and ``pins``.

    ``resolve`` reduces rows of any batches to the rows that count, such as the latest of each
    key or sums by key; it must give the same for rows that it has already reduced in part.
    Batch ids are consecutive. A batch that is run again overwrites its folder and changes
    nothing else, so the table is the same after a failure.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: str, resolve: Callable[[DataFrame], DataFrame],
        compact_every: int = 50, pin_hours: float = PIN_HOURS,
    ):
        self.spark, self.path, self.schema, self.resolve = spark, path.rstrip("/"), schema, resolve
        self.compact_every, self.pin_hours = compact_every, pin_hours
        self.names = [c.strip().split()[0] for c in schema.split(",")]

    def _rows(self, folder: str, schema: str) -> DataFrame:
        """Rows of a folder; none where nothing has been written yet."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{folder}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def manifests(self) -> list[int]:
        """Last batches of the generations that still exist, ascending; a handful."""
        return sorted(r.upto for r in self._rows("manifests", "upto BIGINT").select("upto").distinct().collect())

    def pins(self) -> list[int]:
        held = self._rows("pins", "upto BIGINT, at TIMESTAMP")
        alive = F.col("at") > F.current_timestamp() - F.make_dt_interval(hours=F.lit(self.pin_hours).cast("int"))
        return [r.upto for r in held.filter(alive).select("upto").distinct().collect()]

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """Add a micro-batch, reduced first; compact when it is its turn."""
        rows = self.resolve(batch.select(*self.names))
        rows.write.mode("overwrite").parquet(f"{self.path}/batches/batch={batch_id}")
        if self.compact_every and (batch_id + 1) % self.compact_every == 0:
            self.compact(batch_id)

    def compact(self, upto: int) -> None:
        """Resolve all up to a batch into a snapshot, make it current, remove what no reader needs."""
        known = [g for g in self.manifests() if g < upto]
        rows = self._of(known[-1] if known else None, upto)
        rows.write.mode("overwrite").parquet(f"{self.path}/snapshots/upto={upto}")
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.path}/manifests/upto={upto}")
        # the generation before stays whole: a batch that is run again compacts from it again
        oldest = min([known[-1] if known else -1, *(p for p in self.pins() if p in known or p < 0)])
        gone = [g for g in known if g < oldest]
        for g in gone:
            remove(self.spark, f"{self.path}/manifests/upto={g}")
            remove(self.spark, f"{self.path}/snapshots/upto={g}")
        first = known[0] + 1 if known else 0
        # batches up to a generation are in its snapshot; those of removed ones went with them
        for b in range(max(0, first - self.compact_every), oldest + 1):
            remove(self.spark, f"{self.path}/batches/batch={b}")

    def _of(self, generation: int | None, upto: int | None = None) -> DataFrame:
        """Rows of a generation: its snapshot and the batches after it, up to one of them."""
        batches = self._rows("batches", f"{self.schema}, batch BIGINT")
        after = F.col("batch") > (-1 if generation is None else generation)
        if upto is not None:
            after = after & (F.col("batch") <= upto)
        rows = batches.filter(after).select(*self.names)
        if generation is not None:
            rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/snapshots/upto={generation}").unionByName(rows)
        return self.resolve(rows)

    def read(self) -> DataFrame:
        """The current rows, for a reader that is done before two more compactions."""
        known = self.manifests()
        return self._of(known[-1] if known else None)

    @contextmanager
    def pinned(self) -> Iterator[DataFrame]:
        """The current rows; nothing that they read is removed inside the block."""
        pin = f"{self.path}/pins/pin={uuid.uuid4().hex}"
        while True:
            known = self.manifests()
            generation = known[-1] if known else -1
            row = self.spark.range(1).select(F.lit(generation).cast("bigint").alias("upto"), F.current_timestamp().alias("at"))
            row.write.mode("overwrite").parquet(pin)
            if generation in self.manifests() or (generation < 0 and not self.manifests()):
                break
        try:
            yield self._of(generation if generation >= 0 else None)
        finally:
            remove(self.spark, pin)
