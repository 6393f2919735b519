"""Stream sinks: the latest-state table and live batch progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..operators.progress import latest_events, overall_of_totals
from .generations import Generations

ALL_THERE = {"availableNow": True}
NO_DATA_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
SHUFFLE_PARTITIONS = "spark.sql.shuffle.partitions"
#: Partitions of a stream's state at most. Each is loaded and committed by every micro-batch, with
#: data or without, so they must not grow with the input; what a micro-batch brings does not either.
STATE_PARTITIONS = 32


def _start(writer: DataStreamWriter, spark: SparkSession, trigger: dict | None) -> StreamingQuery:
    """Start a stream; without a trigger, over all that is there.

    Timers on processing time ask for one more batch for ever, so a stream that is to end
    with its input runs no batch without data. A stream with an interval does.
    """
    partitions = min(int(spark.conf.get(SHUFFLE_PARTITIONS)), STATE_PARTITIONS)
    settings = {SHUFFLE_PARTITIONS: str(partitions)} | ({} if trigger else {NO_DATA_BATCHES: "false"})
    # a default given to get() is checked against the setting's type; None is not
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        return writer.trigger(**(trigger or ALL_THERE)).start()
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def latest_table(spark: SparkSession, path: str, schema: str, compact_every: int = 50) -> Generations:
    """The table of the latest row of each job."""
    return Generations(spark, path, schema, latest_events, compact_every)


def latest_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per job; readers that take long use ``latest_table(...).pinned()``."""
    return latest_table(spark, path, schema).read()


def upsert_latest(
    stream: DataFrame, path: str, checkpoint: str, schema: str, compact_every: int = 50,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Keep the latest row of each job in a table; read it with ``latest_state``.

    ``trigger``: arguments of the stream's trigger; all that is there by default.
    """
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda df, i: latest_table(df.sparkSession, path, schema, compact_every).write(df, i)
    )
    return _start(writer, stream.sparkSession, trigger)


TOTALS_SCHEMA = (
    "batch_id BIGINT, completed_files BIGINT, total_files BIGINT, tenths BIGINT, original_bytes BIGINT, output_bytes BIGINT"
)
_SUMS = [c.split()[0] for c in TOTALS_SCHEMA.split(", ")][1:]


def add_totals(rows: DataFrame) -> DataFrame:
    """Sums by batch; rows that are sums already may be added again."""
    return rows.groupBy("batch_id").agg(*[F.sum(c).alias(c) for c in _SUMS])


def changes_of(tracked: DataFrame) -> DataFrame:
    """What each tracker row changes in the totals of its batch; late and rejected rows change nothing."""
    done = F.col("status") == "completed"
    sized = done & F.col("original_size").isNotNull() & F.col("output_size").isNotNull()
    zero = F.lit(0).cast("bigint")
    return tracked.filter("kind = 'event'").select(
        "batch_id", done.cast("bigint").alias("completed_files"), F.col("first").cast("bigint").alias("total_files"),
        F.col("progress_delta").alias("tenths"),
        F.when(sized, F.greatest(zero, F.col("original_size"))).otherwise(zero).alias("original_bytes"),
        F.when(sized, F.greatest(zero, F.col("output_size"))).otherwise(zero).alias("output_bytes"),
    )


def totals_table(spark: SparkSession, path: str, compact_every: int = 50) -> Generations:
    return Generations(spark, path, TOTALS_SCHEMA, add_totals, compact_every)


def live_overall(spark: SparkSession, path: str) -> DataFrame:
    """Progress of every batch now, in the columns of ``overall_progress``."""
    return overall_of_totals(totals_table(spark, path).read())


def stream_overall(
    tracked: DataFrame, path: str, checkpoint: str, compact_every: int = 50, trigger: dict | None = None
) -> StreamingQuery:
    """Live progress per batch, as signed changes: read it with ``live_overall``.

    ``tracked``: tracker rows with a ``batch_id`` and the job's ``original_size``. A
    micro-batch adds up what its rows change, one row per batch, and reads nothing; every
    ``compact_every`` micro-batches the changes are added up, over all batches.
    """
    writer = tracked.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda df, i: totals_table(df.sparkSession, path, compact_every).write(changes_of(df), i)
    )
    return _start(writer, tracked.sparkSession, trigger)


def append_table(
    stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Append a stream to a parquet table."""
    writer = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .option("path", path)
        .outputMode("append")
    )
    return _start(writer, stream.sparkSession, trigger)
