"""Log, benchmark and performance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..operators import benchlog, logs
from ..operators.progress import simple_remaining
from ..session import materialize, shared_dir
from ..sources import files as file_sources
from ..sources import sinks
from ..sources.adapters import Derived, sql_fixed, sql_over, table, view
from . import register

BLOCKS = Derived(
    ["progress_events"],
    """SELECT job_id, sequence, sequence * 7 AS frame, elapsed_cs * 10000 AS out_us, CAST(progress_tenths AS DOUBLE) / 10 AS fps, progress_tenths * 1000 AS total_size,
  event_id % 9 = 0 AS no_time, event_id % 7 = 0 AS clock_time, event_id % 5 = 0 AS repeats, event_id % 11 = 0 AS no_speed,
  job_id % 3 = 0 AND sequence = top AS tail FROM {progress_events}
  JOIN (SELECT job_id AS top_job, max(sequence) AS top FROM {progress_events} GROUP BY job_id) AS tops ON job_id = top_job""",
)


def log_lines(spark, sf_dir):
    """Progress logs as a tool prints them: one block of lines per event, the last one of every third job open."""
    b = BLOCKS.frame(spark, sf_dir)
    c = F.col
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    seconds = F.floor(c("out_us") / 1000000)
    clock = F.format_string(
        "out_time=%02d:%02d:%02d.500", F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60
    )
    lines = F.array_compact(
        F.array(
            text("frame=", c("frame").cast("string")),
            F.when(c("repeats"), text(" frame = ", (c("frame") + 1).cast("string"), "\r")),
            text("fps=", c("fps").cast("string")),
            F.lit("=no key"),
            F.lit("no separator"),
            F.when(c("no_time"), F.lit("out_time=N/A"))
            .when(c("clock_time"), clock)
            .otherwise(text("out_time_us=", c("out_us").cast("string"))),
            text("total_size=", c("total_size").cast("string")),
            F.when(c("no_speed"), F.lit("speed=N/A")).otherwise(F.lit("speed=1.25x")),
            F.lit("bitrate= 812.5kbits/s"),
            F.when(c("tail"), F.lit(None)).when(c("sequence") % 50 != 0, F.lit("progress=continue")).otherwise(F.lit("progress=end")),
        )
    )
    rows = b.select("job_id", "sequence", F.posexplode(lines).alias("pos", "line"))
    return rows.select("job_id", (c("sequence") * 16 + c("pos")).alias("line_no"), "line")


def stored_lines(spark, sf_dir):
    """The same lines as a table: block assembly reads its input twice."""
    return materialize(log_lines(spark, sf_dir), "log-lines")


BLOCK_SQL = f"""
b AS ({BLOCKS.sql()}),
k AS (SELECT job_id, sequence - 1 AS block, CAST(frame + CASE WHEN repeats THEN 1 ELSE 0 END AS DOUBLE) AS frame, fps, 812.5e0 AS bitrate_kbps, CAST(total_size AS DOUBLE) AS total_size,
  CASE WHEN no_time THEN NULL WHEN clock_time THEN CASE WHEN floor(CAST(out_us AS DOUBLE) / 1000000) < 360000 THEN floor(CAST(out_us AS DOUBLE) / 1000000) + 0.5e0 END ELSE CAST(out_us AS DOUBLE) / 1000000 END AS out_time_s,
  CASE WHEN no_speed THEN NULL ELSE 1.25e0 END AS speed, CASE WHEN tail THEN NULL WHEN sequence % 50 <> 0 THEN 'continue' ELSE 'end' END AS state FROM b)"""


@register("w6_assemble_blocks", sql_over(["progress_events"], f"WITH {BLOCK_SQL.strip()} SELECT * FROM k"))
def assemble_blocks(spark, sf_dir):
    return logs.assemble_blocks(stored_lines(spark, sf_dir)).drop("duplicate_frames", "dropped_frames")


@register(
    "s8_progress_log_pairs",
    sql_over(
        ["progress_events"],
        f"""WITH b AS ({BLOCKS.sql()}),
p AS (SELECT job_id, unnest(['frame', 'fps', 'total_size', 'speed', 'bitrate']) AS key FROM b
  UNION ALL SELECT job_id, 'progress' FROM b WHERE NOT tail
  UNION ALL SELECT job_id, 'frame' FROM b WHERE repeats UNION ALL SELECT job_id, CASE WHEN no_time OR clock_time THEN 'out_time' ELSE 'out_time_us' END FROM b)
SELECT job_id, key, count(*) AS lines FROM p GROUP BY ALL""",
    ),
)
def progress_log_pairs(spark, sf_dir):
    pairs = logs.progress_pairs(log_lines(spark, sf_dir))
    return pairs.groupBy("job_id", "key").agg(F.count(F.lit(1)).alias("lines"))


@register(
    "b10_progress_from_metrics",
    sql_over(
        ["progress_events"],
        f"""WITH {BLOCK_SQL.strip()},
j AS (SELECT *, CASE WHEN job_id % 3 = 0 THEN NULL ELSE 400.0e0 END AS d, CASE WHEN job_id % 5 = 0 THEN 0 ELSE 900 END AS n FROM k),
r AS (SELECT *, coalesce(CASE WHEN d > 0 THEN out_time_s / d END, CASE WHEN n > 0 THEN frame / n END) AS ratio FROM j),
p AS (SELECT *, CASE WHEN ratio IS NULL THEN 0.0e0 ELSE {sql_fixed('least(99.0e0, greatest(0.0e0, ratio * 100))', 1)} END AS progress FROM r)
SELECT job_id, block, progress, CASE WHEN progress > 0 THEN CAST(greatest(total_size, floor(total_size / (progress / 100) + 0.5e0)) AS BIGINT) END AS estimated_output_bytes FROM p""",
    ),
)
def progress_from_metrics(spark, sf_dir):
    blocks = logs.assemble_blocks(stored_lines(spark, sf_dir))
    jobs = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id")).distinct().select(
        "job_id",
        F.when(F.col("job_id") % 3 == 0, F.lit(None)).otherwise(F.lit(400.0)).alias("total_duration_s"),
        F.when(F.col("job_id") % 5 == 0, 0).otherwise(900).alias("total_frames"),
    )
    return logs.progress_from_metrics(blocks, jobs).select(
        "job_id", "block", "progress", "estimated_output_bytes"
    )


@register(
    "w4_unsmoothed_remaining",
    sql_over(
        ["progress_events"],
        """SELECT job_id, sequence, CASE WHEN progress_tenths > 0 AND progress_tenths < 1000 THEN
  CAST(greatest(0, floor(CAST(elapsed_cs AS DOUBLE) / 100 / (CAST(progress_tenths AS DOUBLE) / 10) * (100 - CAST(progress_tenths AS DOUBLE) / 10) + 0.5e0)) AS BIGINT) END AS remaining_s FROM progress_events""",
    ),
)
def unsmoothed_remaining(spark, sf_dir):
    rows = view(spark, sf_dir, "progress_events")
    seconds = simple_remaining(F.col("progress_tenths") / 10, F.col("elapsed_cs") / 100)
    return rows.select("job_id", "sequence", seconds.alias("remaining_s"))


PERF = Derived(
    ["encode_attempts"],
    """SELECT file_id AS job_id, CASE file_id % 4 WHEN 0 THEN 'libx264' WHEN 1 THEN 'libx265' WHEN 2 THEN 'h264_qsv' ELSE 'libaom-av1' END AS encoder,
  CAST(CASE WHEN tie_a % 13 = 0 THEN -1 ELSE quality END AS DOUBLE) AS fps, CASE WHEN tie_b % 17 = 0 THEN NULL ELSE CAST(tie_b % 40 AS DOUBLE) / 8 END AS speed,
  CAST(output_bytes % 100000 AS DOUBLE) / 8 AS encoding_ms FROM {encode_attempts}""",
)
PERF_SQL = f"""
s AS ({PERF.sql()}),
m AS (SELECT job_id, any_value(encoder) AS encoder, {sql_fixed('(CAST(sum(CAST(fps AS DECIMAL(28, 6))) FILTER (fps >= 0) AS DOUBLE) / count(fps) FILTER (fps >= 0))', 3)} AS average_fps,
    {sql_fixed('(CAST(sum(CAST(speed AS DECIMAL(28, 6))) FILTER (speed >= 0) AS DOUBLE) / count(speed) FILTER (speed >= 0))', 3)} AS average_speed, max(encoding_ms) AS encoding_ms FROM s GROUP BY job_id),
t AS (SELECT *, {sql_fixed('(encoding_ms + CASE WHEN job_id % 2 = 0 THEN 100.0e0 ELSE 0.0e0 END)', 3)} AS total_ms FROM m)"""


def performance(spark, sf_dir):
    samples = PERF.frame(spark, sf_dir)
    jobs = samples.groupBy("job_id").agg(
        F.max("encoder").alias("encoder"), F.max("encoding_ms").alias("encoding_ms")
    ).withColumn("validation_ms", F.when(F.col("job_id") % 2 == 0, F.lit(100.0)))
    return logs.performance_metrics(samples, jobs)


@register(
    "a6_performance_metrics",
    sql_over(["encode_attempts"], f"WITH {PERF_SQL.strip()} SELECT job_id, encoder, average_fps, average_speed, total_ms FROM t"),
)
def performance_metrics(spark, sf_dir):
    return performance(spark, sf_dir).select("job_id", "encoder", "average_fps", "average_speed", "total_ms")


@register(
    "a6_encoder_summary",
    sql_over(
        ["encode_attempts"],
        f"""WITH {PERF_SQL.strip()}
SELECT encoder, count(*) AS jobs, {sql_fixed('(CAST(sum(CAST(average_fps AS DECIMAL(28, 6))) AS DOUBLE) / count(average_fps))', 3)} AS average_fps,
  {sql_fixed('(CAST(sum(CAST(average_speed AS DECIMAL(28, 6))) AS DOUBLE) / count(average_speed))', 3)} AS average_speed,
  {sql_fixed('CAST(sum(CAST(total_ms AS DECIMAL(28, 6))) AS DOUBLE)', 3)} AS total_ms FROM t GROUP BY encoder""",
    ),
)
def encoder_summary(spark, sf_dir):
    return logs.encoder_summary(performance(spark, sf_dir))


TOOL_LOG = Derived(
    ["encode_attempts"],
    """SELECT codec AS case_id, 'bench: ' || CAST(tie_a AS STRING) || ' user ' || CAST(tie_b AS STRING) || ' sys ' || CAST(output_bytes % 1000000 AS STRING) || ' real ' || CASE ordinal % 3 WHEN 0 THEN 'decode_video' WHEN 1 THEN 'encode_video' ELSE 'scale' END
  || '\n' || CASE WHEN quality % 2 = 0 THEN 'fps=' || CAST(quality AS STRING) ELSE 'speed=' || CAST(CAST(quality AS DOUBLE) / 8 AS STRING) || 'x' END || '\nbench: ' || CAST(tie_b AS STRING) || ' user 1 sys 7 real mux' AS line FROM {encode_attempts}""",
)


@register(
    "a7_tool_log_timings",
    sql_over(
        ["encode_attempts"],
        f"""WITH s AS (SELECT codec AS case_id, CASE ordinal % 3 WHEN 0 THEN 'decode_video' WHEN 1 THEN 'encode_video' ELSE 'scale' END AS stage, output_bytes % 1000000 AS us FROM encode_attempts
  UNION ALL SELECT codec, 'mux', 7 FROM encode_attempts)
SELECT case_id, stage, {sql_fixed('(CAST(sum(us) AS DOUBLE) / 1000)', 3)} AS real_ms FROM s GROUP BY ALL""",
    ),
)
def tool_log_timings(spark, sf_dir):
    return logs.tool_log_timings(TOOL_LOG.frame(spark, sf_dir))


@register(
    "a7_tool_log_means",
    sql_over(
        ["encode_attempts"],
        f"""WITH s AS (SELECT codec AS case_id, CASE WHEN quality % 2 = 0 THEN 'fps' ELSE 'speed' END AS key, CASE WHEN quality % 2 = 0 THEN CAST(quality AS DOUBLE) ELSE CAST(quality AS DOUBLE) / 8 END AS v FROM encode_attempts)
SELECT case_id, key, {sql_fixed('(CAST(sum(CAST(v AS DECIMAL(28, 6))) AS DOUBLE) / count(*))', 3)} AS mean_value, count(*) AS samples FROM s GROUP BY ALL""",
    ),
)
def tool_log_means(spark, sf_dir):
    return logs.tool_log_means(TOOL_LOG.frame(spark, sf_dir))


RAW_LOGS = Derived(
    ["lineitem"],
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 5 = 0 THEN '/tmp/job/' || CAST(l_orderkey AS STRING) ELSE 'job-' || CAST(l_orderkey AS STRING) END AS job,
  CASE WHEN l_linenumber = 1 THEN ' encode ' WHEN l_linenumber = 2 THEN 'a/b' WHEN l_linenumber = 3 THEN '' ELSE 'probe' END AS stage, CASE WHEN l_suppkey % 3 = 0 THEN 'lower_case' ELSE 'DECODE_FAILED' END AS error_code,
  CASE WHEN l_linenumber % 2 = 0 THEN -1.0e0 ELSE CAST(l_partkey AS DOUBLE) / 4 END AS elapsed, CASE WHEN l_partkey % 3 = 0 THEN 'lib x264' ELSE 'h264_qsv' END AS encoder, CAST(l_suppkey AS DOUBLE) AS total FROM {lineitem}""",
)
LOG_SQL = f"""
l AS ({RAW_LOGS.sql()}),
k AS (SELECT CASE WHEN l_partkey % 5 <> 0 THEN job END AS "jobId", CASE l_linenumber WHEN 1 THEN 'encode' WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE 'probe' END AS stage, CASE WHEN l_suppkey % 3 <> 0 THEN error_code END AS "errorCode",
  CASE WHEN elapsed >= 0 THEN elapsed END AS "elapsedMs", CASE WHEN l_partkey % 3 <> 0 THEN encoder END AS encoder, total AS "totalMilliseconds" FROM l)"""


def raw_logs(spark, sf_dir):
    entry = F.struct(
        F.col("job").alias("jobId"), F.col("job").alias("path"), "stage",
        F.col("error_code").alias("errorCode"), F.col("elapsed").alias("elapsedMs"), "encoder",
        F.col("total").alias("totalMilliseconds"),
    )
    return RAW_LOGS.frame(spark, sf_dir).select(F.to_json(entry).alias("raw"))


@register("p7_allowlist_logs", sql_over([], f"WITH {LOG_SQL.strip()} SELECT * FROM k"))
def allowlist_logs(spark, sf_dir):
    return logs.allowlist_logs(raw_logs(spark, sf_dir)).select(
        "jobId", "stage", "errorCode", "elapsedMs", "encoder", "totalMilliseconds"
    )


@register(
    "k3_write_logs",
    sql_over([], f'WITH {LOG_SQL.strip()} SELECT stage, encoder, count(*) AS entries, count("jobId") AS with_job, CAST(sum("totalMilliseconds") AS DOUBLE) AS total_ms FROM k GROUP BY ALL'),
)
def write_logs(spark, sf_dir):
    path = shared_dir(spark, "structured-logs")
    sinks.write_logs(raw_logs(spark, sf_dir), path)
    written = spark.read.schema(logs.LOG_SCHEMA).json(path)
    return written.groupBy("stage", "encoder").agg(
        F.count(F.lit(1)).alias("entries"), F.count("jobId").alias("with_job"),
        F.sum("totalMilliseconds").alias("total_ms"),
    )


MESSAGES = Derived(
    ["documents"],
    """SELECT doc_id AS job_id, lang AS stage, text || CASE WHEN doc_id % 3 = 0 THEN ' failed at /tmp/work/' || CAST(doc_id AS STRING) || '/in.mov' ELSE '' END || CASE WHEN doc_id % 4 = 0 THEN ' see /var/tmp/a.log, /private/tmp/b' ELSE '' END AS message, doc_id % 5 = 0 AS drive FROM {documents}""",
)
REDACT_SQL = f"""
m AS (SELECT job_id, stage, message || CASE WHEN drive THEN ' C:\\work\\x.mp4 and \\\\host\\share' ELSE '' END AS message FROM ({MESSAGES.sql()})),
d AS (SELECT *, len(regexp_extract_all(message, '(?:[A-Za-z]:\\\\|\\\\\\\\)[^\\s"'']+')) AS n1, regexp_replace(message, '(?:[A-Za-z]:\\\\|\\\\\\\\)[^\\s"'']+', '[内部パス]', 'g') AS m1 FROM m),
r AS (SELECT job_id, stage, n1 + len(regexp_extract_all(m1, '/(?:tmp|private/tmp|var/tmp)/[^\\s"'']+')) AS redactions, regexp_replace(m1, '/(?:tmp|private/tmp|var/tmp)/[^\\s"'']+', '[一時ファイル]', 'g') AS message FROM d)"""


def messages(spark, sf_dir):
    rows = MESSAGES.frame(spark, sf_dir)
    tail = F.when(F.col("drive"), F.lit(" C:\\work\\x.mp4 and \\\\host\\share")).otherwise(F.lit(""))
    return rows.select("job_id", "stage", F.concat("message", tail).alias("message"))


@register(
    "p8_redact_messages",
    sql_over([], f"WITH {REDACT_SQL.strip()} SELECT job_id, sha256(message) AS message_digest, CAST(redactions AS INTEGER) AS redactions FROM r"),
)
def redact_messages(spark, sf_dir):
    redacted = logs.redact_messages(messages(spark, sf_dir))
    return redacted.select("job_id", F.sha2("message", 256).alias("message_digest"), "redactions")


@register(
    "p8_redaction_summary",
    sql_over([], f"WITH {REDACT_SQL.strip()} SELECT job_id % 7 AS job_id, stage, CAST(sum(redactions) AS BIGINT) AS redactions, count(*) FILTER (redactions > 0) AS messages_redacted FROM r GROUP BY ALL"),
)
def redaction_summary(spark, sf_dir):
    rows = messages(spark, sf_dir).withColumn("job_id", F.col("job_id") % 7)
    return logs.redaction_summary(logs.redact_messages(rows))


def bench(spark, sf_dir):
    return view(spark, sf_dir, "benchmark_log")


@register(
    "a5_benchmark_matrix",
    sql_over(
        ["benchmark_log"],
        f"""WITH g AS (SELECT case_id, stage, CAST(sum(elapsed_us) FILTER (benchmark = 'before') AS DOUBLE) / 1000 AS a, CAST(sum(elapsed_us) FILTER (benchmark = 'after') AS DOUBLE) / 1000 AS b FROM benchmark_log GROUP BY ALL)
SELECT case_id, stage, {sql_fixed('a', 3)} AS before_ms, {sql_fixed('b', 3)} AS after_ms FROM g""",
    ),
)
def benchmark_matrix(spark, sf_dir):
    return benchlog.benchmark_matrix(bench(spark, sf_dir), ["before", "after"])


COMPARE_SQL = f"""
g AS (SELECT case_id, stage, CAST(sum(elapsed_us) FILTER (benchmark = 'before') AS BIGINT) AS a, CAST(sum(elapsed_us) FILTER (benchmark = 'after') AS BIGINT) AS b FROM benchmark_log GROUP BY ALL)
SELECT case_id, stage, {sql_fixed('(CAST(a AS DOUBLE) / 1000)', 3)} AS first_ms, {sql_fixed('(CAST(b AS DOUBLE) / 1000)', 3)} AS second_ms, {sql_fixed('(CAST(a - b AS DOUBLE) / 1000)', 3)} AS saved_ms,
  CASE WHEN a > 0 THEN {sql_fixed('(CAST(a - b AS DOUBLE) / CAST(a AS DOUBLE) * 100)', 1)} END AS saved_percent FROM g"""


@register("j14_compare_runs", sql_over(["benchmark_log"], f"WITH {COMPARE_SQL.strip()}"))
def compare_runs(spark, sf_dir):
    return benchlog.compare_runs(bench(spark, sf_dir), "before", "after")


@register(
    "a13_stage_summary",
    sql_over(
        ["benchmark_log"],
        f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY elapsed_us) AS rn, count(*) OVER (PARTITION BY stage) AS n FROM benchmark_log)
SELECT stage, count(*) AS rows, count(*) FILTER (case_id = 'R') AS errors, {sql_fixed('(CAST(sum(elapsed_us) AS DOUBLE) / count(*) / 1000)', 3)} AS mean_ms,
  {sql_fixed('(CAST(min(elapsed_us) FILTER (rn >= (n * 95 + 99) // 100) AS DOUBLE) / 1000)', 3)} AS p95_ms FROM r GROUP BY stage""",
    ),
)
def stage_summary(spark, sf_dir):
    rows = bench(spark, sf_dir).withColumn("failed", F.col("case_id") == "R")
    return benchlog.stage_summary(rows)


@register(
    "s1_read_benchmark_log",
    sql_over(
        ["benchmark_log"],
        f"""SELECT benchmark, case_id, CAST(stage AS VARCHAR) AS stage, count(*) AS records, {sql_fixed('(CAST(sum(elapsed_us) AS DOUBLE) / 1000)', 3)} AS elapsed_ms,
  count(*) FILTER (elapsed_us % 3 = 0) AS text_values, count(*) FILTER (elapsed_us % 3 = 1) AS flag_values FROM benchmark_log GROUP BY ALL""",
    ),
)
def read_benchmark_log(spark, sf_dir):
    """The log written as JSON lines with a number, flag or text value, and read back."""
    c = F.col
    path = shared_dir(spark, "benchmark-log")
    head = F.to_json(
        F.struct(
            "benchmark", F.lit("benchmark-stage").alias("type"), c("case_id").alias("caseId"),
            c("stage").cast("string").alias("stage"), (c("elapsed_us") / 1000).alias("elapsedMs"),
        )
    )
    value = F.when(c("elapsed_us") % 3 == 0, F.lit('"infinite"')).when(
        c("elapsed_us") % 3 == 1, F.lit("true")
    ).otherwise(F.lit("42.5"))
    line = F.concat(F.expr("left(head, length(head) - 1)"), F.lit(',"value":'), value, F.lit("}"))
    bench(spark, sf_dir).withColumn("head", head).select(line.alias("value")).write.text(path)
    log = file_sources.read_benchmark_log(spark, path)
    return log.groupBy("benchmark", "case_id", "stage").agg(
        F.count(F.lit(1)).alias("records"),
        # milliseconds with two decimals: exact as decimals
        (F.sum(c("elapsed_ms").cast("decimal(28,6)")).cast("double") + 0.0).alias("elapsed_ms"),
        F.count_if(c("value") == "infinite").alias("text_values"),
        F.count_if(c("value") == "true").alias("flag_values"),
    )
