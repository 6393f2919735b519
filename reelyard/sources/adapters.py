"""The given tables seen as the engine's own inputs.

``VIEW_SQL`` holds the same definitions as SQL text for the checks in another engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.running import running

# One scan chunk of the raw event stream: ten minutes of one job.
EVENT_SLOT_SECONDS = 600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


MEDIA_FILES_SELECT = """
SELECT o_orderkey AS file_id,
       o_custkey AS batch_id,
       CASE WHEN o_orderkey % 5 < 2 THEN 'image' WHEN o_orderkey % 5 < 4 THEN 'video' ELSE 'audio' END AS kind,
       CAST(floor(o_totalprice * 1000) AS BIGINT) AS size_bytes,
       CASE WHEN o_orderkey % 5 < 2 THEN NULL ELSE CAST(10 + o_orderkey % 1790 AS DOUBLE) END AS duration_s,
       CASE WHEN o_orderkey % 5 = 4 THEN NULL
            WHEN o_orderkey % 6 = 0 THEN 2160 WHEN o_orderkey % 6 = 1 THEN 1440 WHEN o_orderkey % 6 = 2 THEN 1080
            WHEN o_orderkey % 6 = 3 THEN 720 WHEN o_orderkey % 6 = 4 THEN 480 ELSE 360 END AS height,
       CASE WHEN o_orderkey % 5 = 4 THEN NULL
            WHEN o_orderkey % 6 = 0 THEN 3840 WHEN o_orderkey % 6 = 1 THEN 2560 WHEN o_orderkey % 6 = 2 THEN 1920
            WHEN o_orderkey % 6 = 3 THEN 1280 WHEN o_orderkey % 6 = 4 THEN 854 ELSE 640 END AS width,
       CASE WHEN o_orderkey % 5 IN (2, 3) THEN CASE WHEN o_orderkey % 3 = 0 THEN 24.0e0 WHEN o_orderkey % 3 = 1 THEN 30.0e0 ELSE 60.0e0 END END AS fps,
       CASE WHEN o_orderkey % 5 < 2 THEN 0 WHEN o_orderkey % 5 = 4 THEN 1 ELSE CAST(o_orderkey % 4 AS INT) END AS audio_track_count,
       CASE WHEN o_orderkey % 5 < 2 OR o_orderkey % 7 = 0 THEN NULL ELSE CAST(96 + 32 * (o_orderkey % 14) AS INT) END AS audio_kbps,
       o_orderkey % 5 < 2 AND o_orderkey % 11 = 0 AS has_alpha,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE 'pending' END AS status,
       o_orderpriority AS priority,
       o_orderdate AS created_at
FROM {orders}"""

ENCODE_ATTEMPTS_SELECT = """
SELECT l_orderkey AS file_id,
       l_linenumber AS ordinal,
       CASE l_returnflag WHEN 'A' THEN 'av1' WHEN 'N' THEN 'h265' ELSE 'h264' END AS codec,
       40 + CAST(floor(l_quantity) AS INT) AS quality,
       CAST(floor(l_extendedprice * 1000) AS BIGINT) AS output_bytes,
       90 + l_discount * 100 AS vmaf_mean,
       75 + l_tax * 200 AS vmaf_min,
       l_linestatus = 'F' AS decoded,
       l_partkey AS tie_a,
       l_suppkey AS tie_b
FROM {lineitem}"""

SIZE_SAMPLES_SELECT = """
SELECT l_orderkey AS file_id,
       CAST(1 + l_linenumber % 3 AS BIGINT) AS duration_s,
       CAST(floor(l_extendedprice) AS BIGINT) AS output_bytes,
       CAST(floor(l_quantity) AS BIGINT) AS processing_ds
FROM {lineitem}"""

FILE_PROGRESS_SELECT = """
SELECT l_orderkey AS batch_id,
       CAST(floor(l_quantity * 2) AS BIGINT) AS progress,
       CASE WHEN l_linestatus = 'F' AND l_returnflag <> 'N' THEN 'completed'
            WHEN l_linestatus = 'F' THEN 'failed' ELSE 'processing' END AS status,
       CAST(floor(l_extendedprice) AS BIGINT) AS original_size,
       CASE WHEN l_linestatus = 'F' THEN CAST(floor(l_extendedprice * (1 - l_discount)) AS BIGINT) END AS output_size
FROM {lineitem}"""

FILE_NAMES_SELECT = """
SELECT p_brand AS batch_id, p_partkey AS ord,
       p_name || '.' || CASE WHEN p_partkey % 3 = 0 THEN 'jpg' WHEN p_partkey % 3 = 1 THEN 'PNG' ELSE 'tiff' END AS original_name,
       'webp' AS output_ext
FROM {part}"""

BENCHMARK_LOG_SELECT = """
SELECT CASE l_linestatus WHEN 'F' THEN 'before' ELSE 'after' END AS benchmark,
       l_returnflag AS case_id, l_linenumber AS stage,
       CAST(floor(l_extendedprice * 100) AS BIGINT) AS elapsed_us
FROM {lineitem}"""

REPLAY_EVENTS_SELECT = """
SELECT conv_id AS job_id, turn AS sequence, role AS stage, length(text) AS n_chars FROM {conversations}"""

VERIFICATION_SELECT = """
SELECT doc_id AS file_id, quality = 1 AS quality_ok, toxic = 0 AS metadata_ok FROM {labels}"""

_SELECTS = {
    "media_files": (MEDIA_FILES_SELECT, "orders"),
    "encode_attempts": (ENCODE_ATTEMPTS_SELECT, "lineitem"),
    "size_samples": (SIZE_SAMPLES_SELECT, "lineitem"),
    "file_progress": (FILE_PROGRESS_SELECT, "lineitem"),
    "file_names": (FILE_NAMES_SELECT, "part"),
    "benchmark_log": (BENCHMARK_LOG_SELECT, "lineitem"),
    "replay_events": (REPLAY_EVENTS_SELECT, "conversations"),
    "verification": (VERIFICATION_SELECT, "labels"),
}

VIEW_SQL = {
    name: select.format(**{source: source}).strip() for name, (select, source) in _SELECTS.items()
}
VIEW_SQL["progress_events"] = """
SELECT event_id, job_id, sequence, ts,
       CASE WHEN event_type = 'purchase' AND event_id % 25 = 0 THEN 'completed'
            WHEN event_type = 'error' AND event_id % 25 = 1 THEN 'failed'
            WHEN event_type = 'signup' THEN 'queued' WHEN event_type = 'view' THEN 'analyzing'
            WHEN event_type = 'click' THEN 'processing' ELSE 'encoding' END AS status,
       CAST(least(1000, sequence * 7 + (event_id * 7919) % 60) AS BIGINT) AS progress_tenths,
       elapsed_cs
FROM (SELECT event_id, user_id AS job_id, ts, event_type,
             row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence,
             CAST(sum(CAST(floor(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS elapsed_cs
      FROM events) q""".strip()
VIEW_SQL["frame_scores"] = """
SELECT vec_id AS candidate_id, CAST(i - 1 AS BIGINT) AS frame, floor((CAST(embedding[i] AS DOUBLE) + 1) * 50000) / 1000 AS score
FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)""".strip()


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An adapter view as a DataFrame."""
    if name == "progress_events":
        return _progress_events(spark, sf_dir)
    if name == "frame_scores":
        return _frame_scores(spark, sf_dir)
    select, source = _SELECTS[name]
    return spark.sql(select, **{source: table(spark, sf_dir, source)})


def _progress_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events numbered per job in time order.

    The running number and clock are scanned slot by slot: a job with a third of all
    events is spread over its time slots instead of one window task.
    """
    raw = table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("job_id"), "ts", "event_type",
        F.floor(F.col("value") * 100).alias("step_cs"),
    )
    slot = F.floor(F.unix_timestamp("ts") / EVENT_SLOT_SECONDS)
    counted = running(
        raw, ["job_id"], ["ts", "event_id"],
        {"sequence": ("count", F.lit(1), True), "elapsed_cs": ("sum", F.col("step_cs"), True)},
        chunk=slot,
    )
    kind, event = F.col("event_type"), F.col("event_id")
    status = (
        F.when((kind == "purchase") & (event % 25 == 0), "completed")
        .when((kind == "error") & (event % 25 == 1), "failed")
        .when(kind == "signup", "queued")
        .when(kind == "view", "analyzing")
        .when(kind == "click", "processing")
        .otherwise("encoding")
    )
    return counted.select(
        "event_id", "job_id", "sequence", "ts", status.alias("status"),
        F.least(F.lit(1000), F.col("sequence") * 7 + (event * 7919) % 60).cast("bigint").alias("progress_tenths"),
        "elapsed_cs",
    )


def _frame_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("candidate_id"), F.posexplode("embedding").alias("pos", "value")
    )
    return frames.select(
        "candidate_id",
        F.col("pos").cast("bigint").alias("frame"),
        (F.floor((F.col("value").cast("double") + 1) * 50000) / 1000).alias("score"),
    )


def sql_over(views: list[str], body: str) -> str:
    """SQL text of a check: the named views as common table expressions, then the body."""
    ctes = ",\n".join(f"{name} AS (\n{VIEW_SQL[name]}\n)" for name in views)
    head = f"WITH RECURSIVE {ctes}" if ctes else "WITH RECURSIVE nothing AS (SELECT 1 AS one)"
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"{head},\n{body[5:]}"
    return f"{head}\n{body}"


def sql_fixed(x: str, digits: int) -> str:
    """SQL text of ``numbers.fixed``."""
    scale = f"1{'0' * digits}.0e0"
    return f"(sign({x}) * floor(abs({x}) * {scale} + 0.5e0) / {scale} + 0.0e0)"


class Derived:
    """A select over views that both engines understand, for inputs the tables lack.

    The text names its inputs as ``{name}``: Spark binds DataFrames, the check reads the
    common table expressions of the same names.
    """

    def __init__(self, inputs: list[str], select: str):
        self.inputs, self.select = inputs, select.strip()

    def sql(self) -> str:
        return self.select.format(**{name: name for name in self.inputs})

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        known = set(_SELECTS) | {"progress_events", "frame_scores"}
        bound = {
            name: view(spark, sf_dir, name) if name in known else table(spark, sf_dir, name)
            for name in self.inputs
        }
        return spark.sql(self.select, **bound)
