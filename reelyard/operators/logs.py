"""Tool logs, progress logs and structured logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions.numbers import clamp, exact_mean, exact_sum, fixed, half_up, share
from ..functions.parsing import clock_seconds, number, with_suffix
from ..functions.staging import settle
from ..session import materialize
from .running import CHUNK_ROWS, running

PROGRESS_KEYS = (
    "frame", "fps", "bitrate", "total_size", "out_time_us", "out_time_ms", "out_time",
    "dup_frames", "drop_frames", "speed", "progress",
)


def progress_pairs(lines: DataFrame, ends: bool = False) -> DataFrame:
    """``key=value`` lines as key and value; lines without a key are dropped.

    With ``ends`` null lines, which mark the end of a log, stay, without key and value.
    """
    end = F.col("line").isNull() if ends else F.lit(False)
    line = F.when(F.contains("line", F.lit("\r")), F.regexp_replace("line", r"\r$", "")).otherwise(F.col("line"))
    # Filters, codes and values read these many times; each is worked out once.
    rows = settle(lines.filter(end | (F.instr("line", "=") > 1)), {"__text": line})
    text, at = F.col("__text"), F.instr("__text", "=")
    rows = settle(
        rows,
        {
            "key": F.trim(F.substring(text, F.lit(1), at - 1)),
            "value": F.trim(F.substring(text, at + 1, F.length(text))),
        },
    )
    return rows.filter(end | (F.col("key") != "")).drop("line", "__text")


def _typed(key: Column, value: Column) -> Column:
    """A line's value as a number; the block states continue and end are 1 and 2."""
    return (
        F.when(key == "bitrate", with_suffix(value, "kbits/s"))
        .when(key == "speed", with_suffix(value, "x"))
        .when(key == "out_time", clock_seconds(value))
        .when(key == "progress", F.when(value == "continue", 1.0).when(value == "end", 2.0))
        .otherwise(number(value))
    )


def metrics_of(values: Column) -> dict[str, Column]:
    """Typed metrics out of one block's key/value struct."""
    raw = {k: values.getField(k) for k in PROGRESS_KEYS}
    micros = number(F.coalesce(raw["out_time_us"], raw["out_time_ms"]))
    return {
        "frame": number(raw["frame"]),
        "fps": number(raw["fps"]),
        "bitrate_kbps": with_suffix(raw["bitrate"], "kbits/s"),
        "total_size": number(raw["total_size"]),
        "out_time_s": F.coalesce(micros / 1_000_000, clock_seconds(raw["out_time"])),
        "duplicate_frames": number(raw["dup_frames"]),
        "dropped_frames": number(raw["drop_frames"]),
        "speed": with_suffix(raw["speed"], "x"),
        "state": F.when(raw["progress"].isin("continue", "end"), raw["progress"]),
    }


def assemble_blocks(
    lines: DataFrame, order: str = "line_no", chunk: Column | None = None, size: int = CHUNK_ROWS
) -> DataFrame:
    """Progress blocks: all lines up to and including ``progress=``.

    The block number is a chunked running count of terminators; the last value of a key
    wins; an open block at the end of the log is kept.
    """
    pairs = progress_pairs(lines).withColumn("number", _typed(F.col("key"), F.col("value")))
    # Both passes of the scan read the typed pairs; the texts are parsed once.
    narrow = {"job_id": F.col("job_id"), order: F.col(order), "key": F.col("key"), "number": F.col("number")}
    if chunk is not None:
        narrow["__chunk_of"], chunk = chunk, F.col("__chunk_of")
    pairs = materialize(pairs.select(*[c.alias(name) for name, c in narrow.items()]), "log-pairs")
    ends = F.when(F.col("key") == "progress", F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    numbered = running(
        pairs, ["job_id"], [order], {"__closed": ("sum", ends, False)},
        chunk=chunk, size=size,
    )
    block = numbered.withColumn("block", F.coalesce("__closed", F.lit(0).cast("bigint")))
    # Numbers instead of texts: the aggregation hashes and never sorts the lines.
    last = {
        k: F.max_by("number", F.when(F.col("key") == k, F.col(order))) for k in PROGRESS_KEYS
    }
    values = block.groupBy("job_id", "block").agg(
        *[v.alias(k) for k, v in last.items()],
        F.max(F.when(F.col("key") == "out_time_us", 1)).alias("__has_us"),
    )
    micros = F.when(F.col("__has_us") == 1, F.col("out_time_us")).otherwise(F.col("out_time_ms"))
    return values.select(
        "job_id", "block", "frame", "fps",
        F.col("bitrate").alias("bitrate_kbps"),
        "total_size",
        F.coalesce(micros / 1_000_000, F.col("out_time")).alias("out_time_s"),
        F.col("dup_frames").alias("duplicate_frames"),
        F.col("drop_frames").alias("dropped_frames"),
        "speed",
        F.when(F.col("progress") == 1, "continue").when(F.col("progress") == 2, "end").alias("state"),
    )


def progress_from_metrics(metrics: DataFrame, jobs: DataFrame) -> DataFrame:
    """Progress and projected output size of each block.

    ``jobs``: job_id, total_duration_s, total_frames. Time wins over frames; 0..99, one
    decimal.
    """
    rows = metrics.join(jobs, "job_id", "left")
    by_time = F.when(F.col("total_duration_s") > 0, F.col("out_time_s") / F.col("total_duration_s"))
    by_frame = F.when(F.col("total_frames") > 0, F.col("frame") / F.col("total_frames"))
    percent = F.coalesce(fixed(clamp(F.coalesce(by_time, by_frame) * 100, 0.0, 99.0), 1), F.lit(0.0))
    rows = rows.withColumn("progress", percent)
    projected = F.greatest(
        F.col("total_size").cast("bigint"),
        half_up(share(F.col("total_size"), F.col("progress") / 100)),
    )
    return rows.withColumn(
        "estimated_output_bytes",
        F.when(F.col("total_size").isNotNull() & (F.col("progress") > 0), projected),
    )


def performance_metrics(samples: DataFrame, jobs: DataFrame) -> DataFrame:
    """Mean speed of valid samples and total time per job.

    ``samples``: job_id, fps, speed. ``jobs``: job_id, encoder, encoding_ms, validation_ms.
    """
    def usable(name: str) -> Column:
        value = F.col(name).cast("double")
        return F.when((value >= 0) & (value < float("inf")) & ~F.isnan(value), value)

    means = samples.groupBy("job_id").agg(
        exact_mean(usable("fps")).alias("average_fps"),
        exact_mean(usable("speed")).alias("average_speed"),
    )
    return jobs.join(means, "job_id", "left").withColumn(
        "total_ms", fixed(F.col("encoding_ms") + F.coalesce("validation_ms", F.lit(0.0)), 3)
    )


def encoder_summary(metrics: DataFrame) -> DataFrame:
    """Jobs, mean speed and total time per encoder."""
    return metrics.groupBy("encoder").agg(
        F.count(F.lit(1)).alias("jobs"),
        exact_mean(F.col("average_fps")).alias("average_fps"),
        exact_mean(F.col("average_speed")).alias("average_speed"),
        fixed(exact_sum(F.col("total_ms")).cast("double"), 3).alias("total_ms"),
    )


# --- fixed values: lines of tool logs ---------------------------------------------
BENCH_LINE = r"bench:\s+\d+ user\s+\d+ sys\s+(\d+) real (\S+)"
VALUE_LINE = r"^([A-Za-z_]+)=([0-9.]+)(x|kbits/s)?$"


def tool_log_timings(lines: DataFrame) -> DataFrame:
    """Milliseconds per tool stage: the sum of every ``real`` value of a case.

    ``lines``: case_id, line. A row may hold a whole log; every match in it counts.
    """
    micros = F.regexp_extract_all("line", F.lit(BENCH_LINE), F.lit(1))
    stages = F.regexp_extract_all("line", F.lit(BENCH_LINE), F.lit(2))
    hits = lines.select(
        "case_id", F.inline(F.arrays_zip(micros.alias("real_us"), stages.alias("stage")))
    )
    return hits.groupBy("case_id", "stage").agg(
        fixed(F.sum(F.col("real_us").cast("bigint")) / 1000, 3).alias("real_ms")
    )


def tool_log_means(lines: DataFrame) -> DataFrame:
    """Mean of every numeric ``key=value`` line of a case."""
    text = F.explode(F.split("line", r"\r?\n"))
    rows = lines.select("case_id", text.alias("line"))
    key = F.regexp_extract("line", VALUE_LINE, 1)
    value = F.regexp_extract("line", VALUE_LINE, 2).try_cast("double")
    hits = rows.select("case_id", key.alias("key"), value.alias("value")).filter(
        (F.col("key") != "") & F.col("value").isNotNull()
    )
    return hits.groupBy("case_id", "key").agg(
        exact_mean(F.col("value")).alias("mean_value"), F.count(F.lit(1)).alias("samples")
    )


LOG_SCHEMA = ", ".join(
    [f"{f} STRING" for f in ("jobId", "fileId", "stage", "errorCode", *dims.LOG_LABEL_FIELDS)]
    + [f"{f} DOUBLE" for f in ("elapsedMs", *dims.LOG_METRIC_FIELDS)]
)


def allowlist_logs(raw: DataFrame) -> DataFrame:
    """Keep the allowed log fields; a value that fails its rule becomes null.

    ``raw``: level?, raw. Unknown keys have no column to go to.
    """
    parsed = settle(raw, {"__log": F.from_json("raw", LOG_SCHEMA)})

    def matching(field: str, pattern: str) -> Column:
        value = F.col(f"__log.{field}")
        return F.when(value.rlike(pattern), value).alias(field)

    def metric(field: str) -> Column:
        value = F.col(f"__log.{field}")
        finite = ~F.isnan(value) & (value < float("inf"))
        return F.when(finite & (value >= 0), value).alias(field)

    stage = F.trim(F.col("__log.stage"))
    safe_stage = F.when(
        (stage != "") & (F.length(stage) <= 80) & ~stage.rlike(r"[\\/]"), stage
    ).alias("stage")
    kept = [c for c in raw.columns if c != "raw"]
    return parsed.select(
        *kept,
        matching("jobId", "^[A-Za-z0-9_-]{1,128}$"),
        matching("fileId", "^[A-Za-z0-9_-]{1,128}$"),
        safe_stage,
        matching("errorCode", "^[A-Z0-9_]{1,80}$"),
        metric("elapsedMs"),
        *[matching(f, "^[A-Za-z0-9._-]{1,80}$") for f in dims.LOG_LABEL_FIELDS],
        *[metric(f) for f in dims.LOG_METRIC_FIELDS],
    )


# --- fixed values: what is redacted, and by what ----------------------------------
DRIVE_PATH = r"""(?:[A-Za-z]:\\|\\\\)[^\s"']+"""
TEMP_PATH = r"""/(?:tmp|private/tmp|var/tmp)/[^\s"']+"""
DRIVE_MARK, TEMP_MARK = "[内部パス]", "[一時ファイル]"


def redact_messages(logs: DataFrame) -> DataFrame:
    """Replace drive and temporary paths in ``message`` and count the replacements."""
    drives = F.regexp_count("message", F.lit(DRIVE_PATH))
    without = F.regexp_replace("message", DRIVE_PATH, DRIVE_MARK)
    return logs.withColumns(
        {
            "redactions": drives + F.regexp_count(without, F.lit(TEMP_PATH)),
            "message": F.regexp_replace(without, TEMP_PATH, TEMP_MARK),
        }
    )


def redaction_summary(redacted: DataFrame) -> DataFrame:
    return redacted.groupBy("job_id", "stage").agg(
        F.sum("redactions").alias("redactions"),
        F.count_if(F.col("redactions") > 0).alias("messages_redacted"),
    )
