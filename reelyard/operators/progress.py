"""Batch operators over progress events, job states and batch progress.

Events carry ``job_id, sequence, ts, status, progress_tenths, elapsed_cs`` and an
``event_id``. ``sequence`` is the per-job order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions.names import extension, normalize_names, with_compressed_stem
from ..functions.numbers import fixed, half_up, saved_percent
from ..functions.parsing import trailing_sequence
from ..functions.staging import settle
from ..session import materialize
from .running import CHUNK_ROWS, chunk_of, previous, running


def is_terminal(status: Column) -> Column:
    return status.isin(*dims.TERMINAL_STATUSES)


def coarse_status(status: Column) -> Column:
    """Fifteen detailed statuses to queued, running, complete, error, cancelled."""
    return dims.lookup(status, dims.COARSE_STATUS, F.lit("running"))


def status_from_stage(stage: Column, progress: Column) -> Column:
    """Detailed status guessed from the stage text when an event has none."""
    expr = None
    for status, pattern in dims.STATUS_PATTERNS:
        hit = stage.rlike(pattern)
        if status == "finalizing":
            hit = hit | (progress >= 99)
        expr = F.when(hit, status) if expr is None else expr.when(hit, status)
    return expr.otherwise("processing")


def overall_progress(files: DataFrame) -> DataFrame:
    """Completed files, mean clamped progress and bytes per batch.

    Progress is summed in whole tenths, so the mean does not depend on task order.
    """
    done = F.col("status") == "completed"
    value = F.col("progress").cast("double")
    safe = F.when(value.isNull() | F.isnan(value), F.lit(0.0)).otherwise(
        F.least(F.lit(99.0), F.greatest(F.lit(0.0), value))
    )
    tenths = F.when(done, F.lit(1000).cast("bigint")).otherwise(half_up(safe * 10))
    sized = done & F.col("original_size").isNotNull() & F.col("output_size").isNotNull()
    zero = F.lit(0).cast("bigint")
    totals = files.groupBy("batch_id").agg(
        F.count_if(done).alias("completed_files"),
        F.count(F.lit(1)).alias("total_files"),
        F.sum(tenths).alias("tenths"),
        F.coalesce(F.sum(F.when(sized, F.greatest(zero, F.col("original_size")))), zero).alias(
            "original_bytes"
        ),
        F.coalesce(F.sum(F.when(sized, F.greatest(zero, F.col("output_size")))), zero).alias(
            "output_bytes"
        ),
    )
    return overall_of_totals(totals)


def overall_of_totals(totals: DataFrame) -> DataFrame:
    """Mean progress and saved bytes out of the sums of each batch."""
    return totals.select(
        "batch_id", "completed_files", "total_files",
        fixed(F.col("tenths") / F.lit(10.0) / F.col("total_files"), 1).alias("progress"),
        "original_bytes", "output_bytes",
        (F.col("original_bytes") - F.col("output_bytes")).alias("saved_bytes"),
    )


def latest_events(events: DataFrame) -> DataFrame:
    """Newest event of each job; aggregates map-side, so hot jobs do not shuffle."""
    newest = F.max_by(F.struct(*events.columns), F.col("sequence")).alias("event")
    return events.groupBy("job_id").agg(newest).select("event.*")


def cap_events(events: DataFrame, limit: int = dims.MAX_EVENT_HISTORY) -> DataFrame:
    """Newest ``limit`` events of each job (the retention rule of the event log)."""
    newest = Window.partitionBy("job_id").orderBy(F.col("sequence").desc())
    return (
        events.withColumn("__rank", F.row_number().over(newest))
        .filter(F.col("__rank") <= limit)
        .drop("__rank")
    )


def cap_log_lines(lines: DataFrame, limit: int = dims.MAX_LOG_LINES) -> DataFrame:
    """Newest ``limit`` distinct log ids of each item: ``job_id, log_id, position``."""
    firsts = lines.groupBy("job_id", "log_id").agg(F.min("position").alias("position"))
    newest = Window.partitionBy("job_id").orderBy(F.col("position").desc())
    return (
        firsts.withColumn("__rank", F.row_number().over(newest))
        .filter(F.col("__rank") <= limit)
        .drop("__rank")
    )


def explode_job_state(documents: DataFrame, limit: int = dims.MAX_EVENT_HISTORY) -> DataFrame:
    """Event history out of persisted job documents ``job_id, document``.

    Keeps events of the document's own job with a numeric sequence and a step list, in
    order, the newest ``limit``.
    """
    schema = (
        "struct<version:int, state:struct<jobId:string>, events:array<struct<jobId:string,"
        " sequence:string, status:string, progress:double, elapsedSeconds:double,"
        " steps:array<struct<id:string>>>>>"
    )
    parsed = settle(
        documents.select("job_id", "document"), {"doc": F.from_json("document", schema)}
    ).filter(
        (F.col("doc.version") == 1) & (F.col("doc.state.jobId") == F.col("job_id"))
    )
    events = parsed.select("job_id", F.explode("doc.events").alias("e")).select(
        "job_id",
        F.col("e.jobId").alias("owner"),
        F.col("e.sequence").try_cast("bigint").alias("sequence"),
        F.col("e.status").alias("status"),
        F.col("e.progress").alias("progress"),
        F.col("e.elapsedSeconds").alias("elapsed_s"),
        F.col("e.steps").isNotNull().alias("has_steps"),
    )
    own = events.filter(
        (F.col("owner") == F.col("job_id")) & F.col("sequence").isNotNull() & F.col("has_steps")
    ).drop("owner", "has_steps")
    return cap_events(own, limit)


def replay(events: DataFrame, cursors: DataFrame, size: int = CHUNK_ROWS) -> DataFrame:
    """Events after each cursor, up to and including the first terminal one.

    ``cursors``: job_id, last_event_id. The cursor is the number at the end of the id.
    """
    after = cursors.select(
        "job_id", trailing_sequence(F.col("last_event_id")).alias("__after")
    )
    pending = events.join(after, "job_id").filter(F.col("sequence") > F.col("__after"))
    return before_end(pending.drop("__after"), size)


def _with_ended(events: DataFrame, scans: dict, size: int) -> DataFrame:
    """Add ``__ended``: whether a terminal event precedes the row, with other scans."""
    flag = F.when(is_terminal(F.col("status")), F.lit(1))
    return running(
        events, ["job_id"], ["sequence"], {"__ended": ("max", flag, False), **scans}, size=size
    )


def before_end(events: DataFrame, size: int = CHUNK_ROWS) -> DataFrame:
    """Each job's events up to and including its first terminal one."""
    return _with_ended(events, {}, size).filter(F.col("__ended").isNull()).drop("__ended")


def normalize_progress(events: DataFrame, size: int = CHUNK_ROWS) -> DataFrame:
    """Monotone progress, frozen at the first terminal event.

    Adds ``progress`` (tenths of a percent): the running maximum capped at 990; 1000 only
    on the completing event; nothing after a job's first terminal event.
    """
    requested = F.least(F.lit(990), F.greatest(F.lit(0), F.col("progress_tenths")))
    # Dropped rows all follow the kept ones, so the peak may be taken over every row.
    rising = _with_ended(events, {"__peak": ("max", requested, True)}, size)
    done = F.col("status") == "completed"
    return (
        rising.filter(F.col("__ended").isNull())
        .withColumn(
            "progress", F.when(done, F.lit(1000)).otherwise(F.col("__peak")).cast("bigint")
        )
        .drop("__peak", "__ended")
    )


def late_events(events: DataFrame, size: int = CHUNK_ROWS) -> DataFrame:
    """Events after their job's first terminal event, the ones ``normalize_progress`` drops."""
    return _with_ended(events, {}, size).filter(F.col("__ended").isNotNull()).drop("__ended")


def illegal_transitions(events: DataFrame, edges: DataFrame, size: int = CHUNK_ROWS) -> DataFrame:
    """Consecutive statuses of a job that are neither equal nor an allowed edge."""
    pairs = previous(
        events.select("job_id", "sequence", "status"),
        ["job_id"], ["sequence"], {"from_status": "status"}, size=size,
    ).filter(F.col("from_status").isNotNull() & (F.col("from_status") != F.col("status")))
    steps = pairs.withColumnRenamed("status", "to_status")
    return steps.join(edges, ["from_status", "to_status"], "left_anti")


def log_feed(events: DataFrame, arrival: str = "arrival", size: int = CHUNK_ROWS) -> DataFrame:
    """Feed entries in arrival order.

    An event whose sequence is not above every earlier one is ignored, so the accepted
    events are the running records; each event id appears once.
    """
    seen = running(
        events, ["job_id"], [arrival], {"__seen": ("max", F.col("sequence"), False)}, size=size
    )
    fresh = seen.filter(F.col("__seen").isNull() | (F.col("sequence") > F.col("__seen")))
    status = F.col("status")
    level = (
        F.when(status == "failed", "error")
        .when(status == "cancelled", "warning")
        .when(status == "completed", "success")
        .otherwise("info")
    )
    # Accepted sequences are unique within a job, so an event id can repeat only with
    # another sequence; the earliest arrival stays.
    others = [c for c in events.columns if c not in ("job_id", "event_id")]
    once = fresh.drop("__seen").groupBy("job_id", "event_id").agg(
        F.min_by(F.struct(*others), F.col(arrival)).alias("__e")
    )
    return once.select("job_id", "event_id", "__e.*").withColumn("level", level)


def stage_index_of(progress: Column, stages: int) -> Column:
    """Stage index implied by progress in percent."""
    safe = F.least(F.lit(99.0), F.greatest(F.lit(0.0), progress))
    return F.least(F.lit(stages - 1), F.floor(safe / 100 * stages)).cast("int")


#: Room for stage indexes below one reset number.
LEVELS = 1000


def infer_stage(
    events: DataFrame, labels: tuple[str, ...], size: int = CHUNK_ROWS
) -> DataFrame:
    """Add ``stage_index`` from the stage text.

    A label match sets the index. A pattern match raises it. Otherwise progress of 99 %
    sets the last stage and anything else carries the index on. Only label and 99 % rows
    can lower it, so: number those resets, then take the running maximum of
    (reset number, index) as one integer. Both run inside chunks, so a hot job is scanned by
    many tasks; a chunk hands on one number.
    """
    stage, last = F.col("stage"), len(labels) - 1
    exact = None
    for i, label in enumerate(labels):
        hit = stage.contains(F.lit(label)) | F.lit(label).contains(stage)
        exact = F.when(hit, i) if exact is None else exact.when(hit, i)
    pattern = None
    for i, text in enumerate(dims.STAGE_PATTERNS):
        hit = stage.rlike(text)
        pattern = F.when(hit, min(i, last)) if pattern is None else pattern.when(hit, min(i, last))
    rows = events.withColumns({"__exact": exact, "__pattern": pattern})
    jump = F.coalesce(
        F.col("__exact"),
        F.when(F.col("__pattern").isNull() & (F.col("progress") >= 99), F.lit(last)),
    )
    rows = rows.withColumn("__jump", jump)
    rows = rows.withColumn("__chunk", chunk_of(F.col("sequence"), size))
    inside = Window.partitionBy("job_id", "__chunk").orderBy("sequence").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__resets", F.sum(F.col("__jump").isNotNull().cast("bigint")).over(inside))
    level = F.col("__resets") * LEVELS + F.coalesce("__jump", "__pattern", F.lit(0))
    rows = rows.withColumn("__level", F.max(level).over(inside))
    # Stored, since the summary of the chunks and the rows both read it: texts are matched once.
    rows = materialize(rows.select(*events.columns, "__chunk", "__level"), "stage-levels")
    # A chunk's last level holds its resets and the index since the last of them, which is
    # all that the chunks after it need; one row per chunk.
    last = rows.groupBy("job_id", "__chunk").agg(F.max("__level").alias("__last"))
    earlier = Window.partitionBy("job_id").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    resets = F.coalesce(F.sum(F.floor(F.col("__last") / LEVELS)).over(earlier), F.lit(0).cast("bigint"))
    before = last.select("job_id", "__chunk", "__last", resets.alias("__before"))
    carried = before.select(
        F.col("job_id").alias("__job"), F.col("__chunk").alias("__head"), "__before",
        F.max(F.col("__before") * LEVELS + F.col("__last")).over(earlier).alias("__carried"),
    )
    # null jobs and sequences stay rows of their own chunk
    same = rows["job_id"].eqNullSafe(F.col("__job")) & rows["__chunk"].eqNullSafe(F.col("__head"))
    final = F.greatest(F.col("__before") * LEVELS + F.col("__level"), F.col("__carried"))
    return rows.join(carried, same).select(*events.columns, (final % LEVELS).cast("int").alias("stage_index"))


def stage_timeline(events: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """Status, start and completion of every stage of every job.

    ``events`` carry ``stage_index``. For stage i an event *opens* it when the job is at
    or past i, *passes* it when the job is past i or complete, and *resets* it when the
    job is before i. Start is the first opening after the last reset; completion the
    first pass after the last event that was still at or before i; a stage that stopped
    completes with the stopping event. Two aggregations per
    job with one column per stage; events are never multiplied by stages.
    """
    stages = range(len(labels))
    status, at, order = F.col("status"), F.col("stage_index"), F.col("sequence")
    complete = status == "completed"
    stopped = status.isin("failed", "cancelled")
    waiting = status.isin(*dims.WAITING_STATUSES)
    reset = [(at < i) & ~complete for i in stages]
    unfinished = [(at <= i) & ~complete & ~((at == i) & stopped) for i in stages]
    opens = [(at > i) | complete | ((at == i) & ~waiting) for i in stages]
    passes = [(at > i) | complete | ((at == i) & stopped) for i in stages]

    # Only fixed-width buffers (no text, no structs): both aggregations hash, none sorts.
    outcome = (
        F.when(complete, 1)
        .when(status == "failed", 2)
        .when(status == "cancelled", 3)
        .when(waiting, 4)
        .otherwise(0)
    )
    marks = events.groupBy("job_id").agg(
        F.max_by(at, order).alias("__at"),
        F.max_by(outcome, order).alias("__outcome"),
        F.max_by("ts", order).alias("__ts"),
        *[F.max(F.when(reset[i], order)).alias(f"__reset_{i}") for i in stages],
        *[F.max(F.when(unfinished[i], order)).alias(f"__open_{i}") for i in stages],
    )
    marked = events.join(marks, "job_id")

    def first_time(hit: Column, after: Column) -> Column:
        return F.min_by("ts", F.when(hit & (after.isNull() | (order > after)), order))

    times = marked.groupBy("job_id").agg(
        *[F.max(c).alias(c) for c in ("__at", "__outcome", "__ts")],
        *[first_time(opens[i], F.col(f"__reset_{i}")).alias(f"__start_{i}") for i in stages],
        *[first_time(passes[i], F.col(f"__open_{i}")).alias(f"__done_{i}") for i in stages],
    )
    final_at, final = F.col("__at"), F.col("__outcome")

    def stage_row(i: int) -> Column:
        state = (
            F.when((final == 1) | (final_at > i), "completed")
            .when(final_at < i, "pending")
            .when(final == 2, "failed")
            .when(final == 3, "cancelled")
            .when(final == 4, "pending")
            .otherwise("processing")
        )
        return F.struct(
            F.lit(i).alias("stage_index"),
            F.lit(labels[i]).alias("label"),
            state.alias("stage_status"),
            F.when((final == 1) | (final_at >= i), F.col(f"__start_{i}")).alias("started_at"),
            F.when(state == "completed", F.col(f"__done_{i}"))
            .when(state.isin("failed", "cancelled"), F.col("__ts"))
            .alias("completed_at"),
        )

    return times.select("job_id", F.inline(F.array(*[stage_row(i) for i in stages])))


ETA_SAMPLES = 8
ETA_MINIMUM = 3


def remaining_time(events: DataFrame) -> DataFrame:
    """Add ``remaining_s``, the smoothed remaining time shown with each event.

    Input is normalised progress (``progress`` in tenths, never falling within a job) and
    the job clock ``elapsed_cs``. A sample counts when both progress and clock exceed
    the last counted one. Progress has 990 levels and at most one sample counts per level,
    so only the rows that could count on a level are folded: the earliest row past every
    clock value of lower levels, and, should a clock have stood still or stepped back,
    the distinct clock values before it. Everything before and after that fold is an
    aggregation or an equi-join on (job, level); no job is collected.
    """
    level, clock, order = F.col("progress"), F.col("elapsed_cs"), F.col("sequence")
    valid = (level > 0) & (level < 1000) & (clock > 0)
    below = Window.partitionBy("job_id").orderBy("progress").rowsBetween(
        Window.unboundedPreceding, -1
    )
    levels = (
        events.groupBy("job_id", "progress")
        .agg(
            F.min(F.when(valid, order)).alias("__first"),
            F.min_by(F.when(valid, clock), F.when(valid, order)).alias("__first_clock"),
            F.max(F.when(valid, clock)).alias("__top"),
        )
        .withColumn("__bound", F.max("__top").over(below))
    )
    first, bound = F.col("__first"), F.col("__bound")
    moved_on = bound.isNull() | (F.col("__first_clock") > bound)
    clean = levels.filter(first.isNotNull() & moved_on).select(
        "job_id", "progress", first.alias("sequence"), F.col("__first_clock").alias("elapsed_cs")
    )
    # Levels that begin with a clock already reached lower down: look at their rows again.
    unclear = levels.filter(first.isNotNull() & ~moved_on).select("job_id", "progress", "__bound")
    reopened = (
        events.filter(valid)
        .join(unclear, ["job_id", "progress"])
        .groupBy("job_id", "progress", F.when(clock <= bound, clock).alias("__reached"))
        .agg(
            F.min("sequence").alias("sequence"),
            F.min_by("elapsed_cs", "sequence").alias("elapsed_cs"),
        )
        .drop("__reached")
    )
    samples = clean.unionByName(reopened)
    folded = samples.groupBy("job_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    order.alias("sequence"),
                    level.alias("progress"),
                    (level / F.lit(10.0)).alias("p"),
                    (clock / F.lit(100.0)).alias("t"),
                )
            )
        ).alias("__samples")
    )
    # One constant state per job: counted samples, smoothed value, emitted steps.
    start = F.expr(
        "named_struct('p', CAST(NULL AS DOUBLE), 't', CAST(NULL AS DOUBLE),"
        " 'recent', CAST(array() AS ARRAY<DOUBLE>), 'smooth', CAST(NULL AS DOUBLE),"
        " 'steps', CAST(array() AS ARRAY<STRUCT<progress: BIGINT, at: BIGINT, value: BIGINT>>))"
    )

    def step(state: Column, x: Column) -> Column:
        counts = state["p"].isNull() | ((x["p"] > state["p"]) & (x["t"] > state["t"]))
        remaining = x["t"] / x["p"] * (F.lit(100.0) - x["p"])
        recent = F.slice(
            F.concat(F.array(remaining), state["recent"]), 1, ETA_SAMPLES
        )  # newest first
        return F.when(counts, _counted(state, x, recent)).otherwise(state)

    def _counted(state: Column, x: Column, recent: Column) -> Column:
        ready = (F.size(recent) >= ETA_MINIMUM) & (x["p"] >= 1) & (x["t"] >= 2)
        smooth = F.when(ready, _blend(state["smooth"], recent)).otherwise(state["smooth"])
        shown = F.when(ready, F.greatest(F.lit(0).cast("bigint"), half_up(smooth)))
        steps = F.when(
            ready,
            F.concat(
                state["steps"],
                F.array(
                    F.struct(
                        x["progress"].alias("progress"), x["sequence"].alias("at"),
                        shown.alias("value"),
                    )
                ),
            ),
        ).otherwise(state["steps"])
        return F.struct(
            x["p"].alias("p"), x["t"].alias("t"), recent.alias("recent"),
            smooth.alias("smooth"), steps.alias("steps"),
        )

    def _blend(smooth: Column, recent: Column) -> Column:
        # Weighted mean, oldest sample weight 1: add oldest first, as the samples arrive.
        n = F.size(recent)
        total = F.aggregate(
            F.sequence(F.lit(1), n),
            F.lit(0.0),
            lambda acc, w: acc + F.element_at(recent, n - w + 1) * w,
        )
        mean = total / (n * (n + 1) / 2)
        return F.when(smooth.isNull(), mean).otherwise(smooth * 0.65 + mean * 0.35)

    steps = folded.select(
        "job_id", F.inline(F.aggregate("__samples", start, step, lambda s: s["steps"]))
    )
    # A step holds from its event until the next one; on the level of a step, the step's
    # own row splits before and after.
    placed = steps.select(
        "job_id", "progress", F.col("at").alias("__at"), F.col("value").alias("__value")
    )
    levels = levels.select("job_id", "progress").join(placed, ["job_id", "progress"], "left")
    levels = levels.withColumn("__before", F.last("__value", ignorenulls=True).over(below))
    shown = F.when(
        F.col("__at").isNotNull() & (order >= F.col("__at")), F.col("__value")
    ).otherwise(F.col("__before"))
    return (
        events.join(levels, ["job_id", "progress"])
        .withColumn(
            "remaining_s",
            F.when(F.col("status") == "completed", F.lit(0).cast("bigint")).otherwise(shown),
        )
        .drop("__at", "__value", "__before")
    )


def simple_remaining(progress: Column, elapsed_s: Column) -> Column:
    """Unsmoothed remaining seconds of a single observation."""
    ok = (progress > 0) & (progress < 100) & (elapsed_s >= 0)
    return F.when(
        ok, F.greatest(F.lit(0).cast("bigint"), half_up(elapsed_s / progress * (100 - progress)))
    )


def stalled_jobs(events: DataFrame, now_ms: Column, stall_ms: int, run_ms: int) -> DataFrame:
    """Unfinished jobs that are silent or running for too long at ``now_ms``.

    The batch form of the stream tracker's timer.
    """
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    jobs = events.groupBy("job_id").agg(
        F.min(ms).alias("__first"),
        F.max(ms).alias("__last"),
        F.max("sequence").alias("sequence"),
        F.bool_or(is_terminal(F.col("status"))).alias("__finished"),
    )
    limit = F.greatest(
        F.least(F.col("__last") + stall_ms, F.col("__first") + run_ms), F.col("__last") + 1
    )
    return jobs.filter(~F.col("__finished") & (limit <= now_ms)).select(
        "job_id", "sequence", (now_ms - F.col("__last")).alias("silent_ms")
    )


def recover_jobs(active: DataFrame, latest: DataFrame) -> DataFrame:
    """Stored active jobs against the latest state.

    ``active``: job_id, item_id, kind, original_size, started_ms. Missing or terminal jobs
    are forgotten, the others resume with the latest event's fields.
    """
    joined = active.join(
        latest.select(
            "job_id", F.col("status").alias("__status"), F.col("progress_tenths").alias("__tenths"),
            F.col("sequence").alias("__sequence"), F.col("elapsed_cs").alias("__elapsed"),
        ),
        "job_id",
        "left",
    )
    status = F.col("__status")
    action = F.when(status.isNull() | is_terminal(status), "forget").otherwise("resume")
    reason = (
        F.when(status.isNull(), "missing").when(is_terminal(status), "terminal").otherwise("active")
    )
    coarse = (
        F.when(status == "completed", "complete")
        .when(status == "failed", "error")
        .when(status == "cancelled", "cancelled")
        .when(status.isin("pending", "queued"), "queued")
        .otherwise("processing")
    )
    return joined.select(
        "job_id", "item_id", "kind",
        action.alias("action"), reason.alias("reason"),
        F.when(status.isNotNull(), coarse).alias("item_status"),
        (F.coalesce("__tenths", F.lit(0).cast("bigint")) / 10).alias("progress"),
        F.coalesce("__sequence", F.lit(0).cast("bigint")).alias("sequence"),
        F.coalesce(F.col("__elapsed") / 100, F.lit(0.0)).alias("elapsed_s"),
        F.when(F.col("kind") != "image", F.col("job_id")).alias("upload_id"),
    )


def assemble_results(manifests: DataFrame, latest: DataFrame) -> DataFrame:
    """Result rows: manifest joined to the latest event, with names, saved bytes, percent.

    ``manifests``: job_id, output_name, original_name?, download_name?, output_size.
    ``latest``: job_id, file_name?, kind?, original_size?, output_format?, elapsed_s?.
    """
    joined = manifests.join(latest, "job_id", "left").withColumn(
        "__name", F.coalesce("file_name", "original_name", "output_name")
    )
    joined = joined.withColumn("__plain", F.col("__name"))
    named = with_compressed_stem(normalize_names(joined, "__name"), "__name", "__stem")
    # a leading dot begins a name, not an extension
    dotted = F.instr(F.substring("output_name", 2, 1 << 20), ".") > 0
    ext = F.when(dotted, F.substring_index("output_name", ".", -1)).otherwise("")
    original = F.coalesce("original_size", "output_size")
    return named.select(
        "job_id",
        F.coalesce("kind", F.lit("image")).alias("kind"),
        F.col("__plain").alias("file_name"),
        F.coalesce("download_name", F.concat(F.col("__stem"), F.lit("."), extension(ext))).alias(
            "download_name"
        ),
        F.coalesce("output_format", F.lower(ext)).alias("output_format"),
        original.alias("original_size"),
        "output_size",
        (original - F.col("output_size")).alias("saved_bytes"),
        saved_percent(original, F.col("output_size")).alias("reduction_percent"),
        "elapsed_s",
    )


def history(results: DataFrame, limit: int = dims.MAX_HISTORY) -> DataFrame:
    """Newest entry of each job, then the newest ``limit`` entries."""
    newest = results.groupBy("job_id").agg(
        F.max_by(F.struct(*results.columns), F.struct("created_at", "entry_id")).alias("e")
    )
    return (
        newest.select("e.*")
        .orderBy(F.col("created_at").desc(), F.col("entry_id").desc())
        .limit(limit)
    )


