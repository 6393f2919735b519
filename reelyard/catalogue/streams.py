"""Streaming queries, run over the event table in time slices until all data is read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import progress as progress_ops
from ..session import materialize, shared_dir
from ..sources.adapters import sql_over, view
from ..streaming import blocks, events, tables
from ..streaming.buckets import cell_of
from . import register
from .logs import BLOCK_SQL, stored_lines
from .progress import NORMAL_SQL, REMAINING_SQL

# Time bounds of the slices the event table is fed in.
SLICE_ENDS = ("2024-01-11", "2024-01-21", None)


def _slices(df: DataFrame, column: str = "ts") -> list[DataFrame]:
    out, start = [], None
    for end in SLICE_ENDS:
        part = df
        if start is not None:
            part = part.filter(F.col(column) >= F.lit(start).cast("timestamp"))
        if end is not None:
            part = part.filter(F.col(column) < F.lit(end).cast("timestamp"))
        out.append(part)
        start = end
    return out


def feed(
    parts: list[DataFrame], path: str, start: Callable[[DataFrame], StreamingQuery],
    batch_bytes: int = events.BATCH_BYTES,
) -> None:
    """Write one slice after another and let the stream over the folder catch up after each.

    What a slice holds of one job lies in one file, so the limit on the bytes of a
    micro-batch never splits it. So do jobs that share a cell of state: a slice of many
    micro-batches still reads and writes each cell once.
    """
    for part in parts:
        part.repartition(cell_of("job_id")).write.mode("append").parquet(path)
        stream = part.sparkSession.readStream.schema(part.schema).option("maxBytesPerTrigger", batch_bytes).parquet(path)
        start(stream).awaitTermination()


def event_rows(spark, sf_dir) -> DataFrame:
    rows = view(spark, sf_dir, "progress_events")
    return rows.select(
        "event_id", "job_id", "sequence", F.col("ts").cast("timestamp").alias("ts"), "status",
        "progress_tenths", "elapsed_cs", (F.col("progress_tenths") * 1000).alias("output_size"),
    )


def deliveries(spark, sf_dir) -> list[DataFrame]:
    """The event table as it arrives: slices of ten days, a seventh of the events one slice
    late, a fifth of them again one slice later, and events that have lost their sequence."""
    rows = event_rows(spark, sf_dir)
    base = F.lit(0)
    for end in SLICE_ENDS[:-1]:
        base = base + (F.col("ts") >= F.lit(end).cast("timestamp")).cast("int")
    last = F.lit(len(SLICE_ENDS) - 1)
    after = F.least(base + 1, last)
    sequence, event = F.col("sequence"), F.col("event_id")
    sent = lambda at, number: F.struct(at.alias("slice"), number.alias("sequence"))
    times = F.array_compact(F.array(
        sent(F.when(event % 7 == 3, after).otherwise(base), sequence),
        F.when(event % 5 == 0, sent(after, sequence)),
        F.when(event % 11 == 0, sent(base, F.lit(None).cast("bigint"))),
    ))
    kept = [c for c in rows.columns if c != "sequence"]
    # The events are numbered once; every slice reads the table.
    both = materialize(rows.select(*kept, F.inline(times)), "deliveries").select("slice", *rows.columns)
    return [both.filter(F.col("slice") == i).drop("slice") for i in range(len(SLICE_ENDS))]


def delivered_sql(body: str) -> str:
    """A check over the accepted deliveries: ``progress_events`` are those, ``delivered`` all."""
    text = sql_over(["progress_events"], body)
    head = "progress_events AS ("
    at = text.index(head)
    depth, end = 1, at + len(head)
    while depth:
        depth += {"(": 1, ")": -1}.get(text[end], 0)
        end += 1
    source = text[at + len(head) : end - 1]
    based = "CASE WHEN CAST(ts AS TIMESTAMP) < TIMESTAMP '2024-01-11' THEN 0 WHEN CAST(ts AS TIMESTAMP) < TIMESTAMP '2024-01-21' THEN 1 ELSE 2 END"
    ctes = f"""raw_events AS ({source}),
based AS (SELECT *, {based} AS base FROM raw_events),
delivered AS (
  SELECT *, CASE WHEN event_id % 7 = 3 THEN least(base + 1, 2) ELSE base END AS slice FROM based
  UNION ALL SELECT *, least(base + 1, 2) FROM based WHERE event_id % 5 = 0
  UNION ALL SELECT * REPLACE (CAST(NULL AS BIGINT) AS sequence), base FROM based WHERE event_id % 11 = 0),
tops AS (SELECT job_id, slice, max(sequence) AS top FROM delivered GROUP BY job_id, slice),
progress_events AS (
  SELECT DISTINCT d.* EXCLUDE (slice, base) FROM delivered d WHERE d.sequence IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM tops t WHERE t.job_id = d.job_id AND t.slice < d.slice AND t.top >= d.sequence))"""
    return text[:at] + ctes + text[end:]


# Longer than any run takes.
QUARTER_MS = 90 * 24 * 3600 * 1000
SILENCE_MS = 6 * 3600 * 1000
#: A job whose events only let time pass for the others.
TICK_JOB = -1


def tracked(stream: DataFrame, stall_ms: int = QUARTER_MS, retention_ms: int = QUARTER_MS) -> DataFrame:
    return events.track_jobs(stream, stall_ms=stall_ms, run_ms=QUARTER_MS, retention_ms=retention_ms)


def tick(spark, number: int) -> DataFrame:
    ts = F.lit("2024-03-01").cast("timestamp")
    return spark.range(1).select(
        F.lit(-number).cast("bigint").alias("event_id"), F.lit(TICK_JOB).cast("bigint").alias("job_id"),
        F.lit(number).cast("bigint").alias("sequence"), ts.alias("ts"), F.lit("processing").alias("status"),
        *[F.lit(0).cast("bigint").alias(c) for c in ("progress_tenths", "elapsed_cs", "output_size")],
    )


def run_tracker(spark, sf_dir, stall_ms: int = QUARTER_MS, retention_ms: int = QUARTER_MS) -> DataFrame:
    """Tracker output over all deliveries of the event table, and one tick."""
    home = shared_dir(spark, "track")
    feed(
        [*deliveries(spark, sf_dir), tick(spark, 1)], f"{home}/in",
        lambda stream: tables.append_table(
            tracked(stream, stall_ms, retention_ms), f"{home}/out", f"{home}/checkpoint"
        ),
    )
    rows = spark.read.schema(events.TRACK_SCHEMA).parquet(f"{home}/out")
    return rows.filter(F.col("job_id") != TICK_JOB)


@register(
    "x1_ingest",
    delivered_sql(
        """WITH a AS (SELECT job_id, count(*) AS events, CAST(sum(event_id) AS BIGINT) AS id_sum FROM progress_events GROUP BY job_id),
d AS (SELECT job_id, count(sequence) AS usable, count(*) AS sent FROM delivered GROUP BY job_id)
SELECT job_id, events, id_sum, usable - events AS late, sent - usable AS rejected FROM a JOIN d USING (job_id)"""
    ),
)
def ingest(spark, sf_dir):
    """Every delivery is marked, none is lost."""
    home = shared_dir(spark, "ingest")
    feed(
        deliveries(spark, sf_dir), f"{home}/in",
        lambda stream: tables.append_table(
            events.ingest(stream), f"{home}/out", f"{home}/checkpoint"
        ),
    )
    marked = spark.read.schema(events.INGEST_SCHEMA).parquet(f"{home}/out")
    kind = F.col("kind")
    return marked.groupBy("job_id").agg(
        F.count_if(kind == "event").alias("events"),
        F.sum(F.when(kind == "event", F.col("event_id"))).alias("id_sum"),
        F.count_if(kind == "late").alias("late"), F.count_if(kind == "rejected").alias("rejected"),
    )


def _sql_of(query_name: str) -> str:
    from . import _ENTRIES

    return _ENTRIES[query_name].sql


TRACK_BODY = f"""WITH {NORMAL_SQL.strip()},
e AS (SELECT n.job_id, n.sequence, n.status, CAST(n.progress AS BIGINT) AS progress, e.progress_tenths * 1000 AS output_size FROM normal n JOIN progress_events e USING (job_id, sequence))
SELECT *, CASE WHEN progress > 0 THEN CAST(greatest(output_size, floor(CAST(output_size AS DOUBLE) / (CAST(progress AS DOUBLE) / 1000) + 0.5e0)) AS BIGINT) END AS estimated_output_size FROM e"""


@register(
    "x2_track_jobs",
    f"""SELECT t.*, r.remaining_s FROM ({delivered_sql(TRACK_BODY)}) t
JOIN ({delivered_sql(REMAINING_SQL)}) r ON r.job_id = t.job_id AND r.sequence = t.sequence""",
)
def track_jobs(spark, sf_dir):
    return run_tracker(spark, sf_dir).filter("kind = 'event'").select(
        "job_id", "sequence", "status", "progress", "output_size", "estimated_output_size",
        "remaining_s",
    )


LATE_SQL = f"""WITH {NORMAL_SQL.strip()},
n AS (SELECT job_id, count(*) AS kept FROM normal GROUP BY job_id),
d AS (SELECT job_id, count(sequence) AS usable FROM delivered GROUP BY job_id)
SELECT job_id, usable - kept AS late_events FROM n JOIN d USING (job_id) WHERE usable > kept"""


@register("x6_stream_late_events", delivered_sql(LATE_SQL))
def stream_late_events(spark, sf_dir):
    late = run_tracker(spark, sf_dir).filter("kind = 'late'")
    return late.groupBy("job_id").agg(F.count(F.lit(1)).alias("late_events"))


@register("x3_state_expiry", delivered_sql(LATE_SQL))
def state_expiry(spark, sf_dir):
    """Late events after a finished job's state is gone: still late, no job starts anew."""
    late = run_tracker(spark, sf_dir, retention_ms=1).filter("kind = 'late'")
    return late.groupBy("job_id").agg(F.count(F.lit(1)).alias("late_events"))


STALLED_SQL = f"""
j AS (SELECT job_id, epoch_us(max(ts)) // 1000 AS last_ms, max(sequence) AS sequence, bool_or(status IN ('completed', 'failed', 'cancelled')) AS finished FROM progress_events GROUP BY job_id),
n AS (SELECT epoch_us(max(ts)) // 1000 - 3600000 AS now_ms FROM progress_events)
SELECT job_id, sequence, now_ms - last_ms AS silent_ms FROM j, n WHERE NOT finished AND last_ms + {SILENCE_MS} <= now_ms"""


@register("x4_stalled_jobs", sql_over(["progress_events"], f"WITH {STALLED_SQL.strip()}"))
def stalled_jobs(spark, sf_dir):
    """Jobs silent for six hours, one hour before the newest event."""
    rows = view(spark, sf_dir, "progress_events")
    newest = rows.agg(F.max(F.unix_millis(F.col("ts").cast("timestamp"))).alias("m")).scalar()
    return progress_ops.stalled_jobs(rows, newest - 3_600_000, SILENCE_MS, QUARTER_MS)


@register(
    "x4_stream_stalled_jobs",
    delivered_sql(
        "SELECT job_id, max(sequence) AS sequence FROM progress_events GROUP BY job_id HAVING NOT bool_or(status IN ('completed', 'failed', 'cancelled'))"
    ),
)
def stream_stalled_jobs(spark, sf_dir):
    """Open jobs, reported by the tracker's timers after a silence of one millisecond."""
    rows = run_tracker(spark, sf_dir, stall_ms=1)
    last = rows.filter("kind = 'event'").groupBy("job_id").agg(F.max("sequence").alias("sequence"))
    stalled = rows.filter("kind = 'stalled'").select("job_id", "sequence").distinct()
    return stalled.join(last, ["job_id", "sequence"], "left_semi")


@register("k2_upsert_latest", _sql_of("w1_latest_events"))
def upsert_latest(spark, sf_dir):
    home = shared_dir(spark, "latest")
    feed(
        _slices(event_rows(spark, sf_dir)), f"{home}/in",
        lambda stream: tables.upsert_latest(
            stream, f"{home}/table", f"{home}/checkpoint", events.EVENT_SCHEMA, 2
        ),
    )
    return tables.latest_state(spark, f"{home}/table", events.EVENT_SCHEMA).select(
        "job_id", "event_id", "sequence", "status", "progress_tenths", "elapsed_cs"
    )


@register(
    "x5_stream_overall",
    delivered_sql(
        f"""WITH {NORMAL_SQL.strip()},
l AS (SELECT n.*, e.progress_tenths * 1000 AS output_size, row_number() OVER (PARTITION BY n.job_id ORDER BY n.sequence DESC) AS rn FROM normal n JOIN progress_events e USING (job_id, sequence)),
g AS (SELECT job_id % 10 AS batch_id, count(*) FILTER (status = 'completed') AS completed_files, count(*) AS total_files, sum(progress) AS tenths,
  coalesce(sum(2000000 + job_id * 10) FILTER (status = 'completed'), 0) AS o, coalesce(sum(output_size) FILTER (status = 'completed'), 0) AS p FROM l WHERE rn = 1 GROUP BY ALL)
SELECT batch_id, completed_files, total_files, (floor(CAST(tenths AS DOUBLE) / 10 / total_files * 10 + 0.5e0) / 10) AS progress, CAST(o AS BIGINT) AS original_bytes, CAST(p AS BIGINT) AS output_bytes, CAST(o - p AS BIGINT) AS saved_bytes FROM g"""
    ),
)
def stream_overall(spark, sf_dir):
    home = shared_dir(spark, "overall")
    feed(
        deliveries(spark, sf_dir), f"{home}/in",
        lambda stream: tables.stream_overall(
            tracked(stream).withColumns({"batch_id": F.col("job_id") % 10, "original_size": 2_000_000 + F.col("job_id") * 10}),
            f"{home}/table", f"{home}/checkpoint", 2,
        ),
    )
    return tables.live_overall(spark, f"{home}/table")


@register(
    "s7_stream_progress",
    sql_over(["progress_events"], "SELECT status, count(*) AS events, CAST(sum(elapsed_cs) AS BIGINT) AS elapsed_cs FROM progress_events GROUP BY status"),
)
def stream_progress(spark, sf_dir):
    """Events as JSON lines, each followed by a blank line."""
    home = shared_dir(spark, "progress-lines")
    rows = event_rows(spark, sf_dir)
    lines = rows.select(F.concat(F.to_json(F.struct(*rows.columns)), F.lit("\n  ")).alias("value"))
    lines.write.text(f"{home}/in")
    stream = events.stream_progress(spark, f"{home}/in", batch_bytes=256 << 10)
    tables.append_table(stream, f"{home}/out", f"{home}/checkpoint").awaitTermination()
    read = spark.read.schema(events.EVENT_SCHEMA).parquet(f"{home}/out")
    return read.groupBy("status").agg(
        F.count(F.lit(1)).alias("events"), F.sum("elapsed_cs").alias("elapsed_cs")
    )


@register("x7_stream_blocks", sql_over(["progress_events"], f"WITH {BLOCK_SQL.strip()} SELECT * FROM k"))
def stream_blocks(spark, sf_dir):
    """Log lines cut into three pieces in the middle of blocks; the last brings the end of each log."""
    home = shared_dir(spark, "blocks")
    lines = stored_lines(spark, sf_dir)
    cut = F.col("line_no")
    last = lines.filter(cut >= 700).unionByName(blocks.end_of_logs(lines))
    parts = [lines.filter(cut < 325), lines.filter((cut >= 325) & (cut < 700)), last]
    feed(
        parts, f"{home}/in",
        lambda stream: tables.append_table(
            blocks.stream_blocks(stream), f"{home}/out", f"{home}/checkpoint"
        ),
    )
    return spark.read.parquet(f"{home}/out").drop(
        "duplicate_frames", "dropped_frames"
    )
