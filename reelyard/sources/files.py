"""File sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parsing import valid_job_id
from ..functions.staging import settle
from ..operators.intake import classify_headers
from .heads import list_files, open_root, with_bytes

#: What the header rules look at.
HEAD_BYTES = 4

BENCHMARK_SCHEMA = (
    "benchmark STRING, type STRING, caseId STRING, stage STRING, elapsedMs DOUBLE, status STRING,"
    " metric STRING, value STRING, bytes BIGINT, codec STRING, passes INT, fixtureId STRING,"
    " encoder STRING, encodingMilliseconds DOUBLE, outputValidationMilliseconds DOUBLE,"
    " totalMilliseconds DOUBLE, averageEncodingFps DOUBLE, averageSpeedRatio DOUBLE,"
    " hardwareEncoders ARRAY<STRING>, speedPreset STRING"
)
_BENCHMARK_NAMES = {
    "caseId": "case_id", "elapsedMs": "elapsed_ms", "fixtureId": "fixture_id",
    "encodingMilliseconds": "encoding_ms", "outputValidationMilliseconds": "validation_ms",
    "totalMilliseconds": "total_ms", "averageEncodingFps": "avg_fps",
    "averageSpeedRatio": "avg_speed", "hardwareEncoders": "hardware_encoders",
    "speedPreset": "speed_preset",
}


def read_benchmark_log(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark JSON lines under one schema; the mixed-type ``value`` stays text."""
    rows = spark.read.schema(BENCHMARK_SCHEMA).json(path)
    return rows.withColumnsRenamed(_BENCHMARK_NAMES)


# --- fixed values: document files and their id fields ----------------------------
DOCUMENT_KINDS = {
    "manifest": ("manifest.json", "jobId"),
    "result": ("result.json", "jobId"),
    "staged": ("staged-media.json", "uploadId"),
    "state": ("job-state.json", "state.jobId"),
}
NAME_FIELDS = (
    "outputName", "inputName", "previewName", "originalPreviewName", "beforePreviewName",
    "afterPreviewName",
)


def read_document_texts(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """``path, document`` of every job directory's document of a kind.

    Job folders are walked by tasks; only files of that name are opened.
    """
    file_name, _ = DOCUMENT_KINDS[kind]
    below = F.array_size(F.split("path", "/")) - F.lit(open_root(root)[1].count("/") + open_root(root)[2].count("/"))
    named = list_files(spark, root).filter((F.substring_index("path", "/", -1) == file_name) & (below == 3))
    return with_bytes(named, root, None).select("path", F.col("content").cast("string").alias("document"))


def job_documents(texts: DataFrame, kind: str) -> DataFrame:
    """Documents whose id matches their directory and whose file names are bare names."""
    file_name, id_field = DOCUMENT_KINDS[kind]
    pattern = r"([^/]+)/" + file_name.replace(".", r"\.") + "$"
    fields = [f"{name} STRING" for name in NAME_FIELDS]
    fields += ["jobId STRING", "uploadId STRING", "state STRUCT<jobId: STRING>"]
    rows = settle(
        texts,
        {
            "job_id": F.regexp_extract("path", pattern, 1),
            "__doc": F.from_json("document", ", ".join(fields)),
        },
    )
    bare = F.lit(True)
    for name in NAME_FIELDS:
        value = F.col(f"__doc.{name}")
        bare = bare & (value.isNull() | ~value.rlike(r"[/\\]"))
    return rows.filter(
        valid_job_id(F.col("job_id")) & (F.col("job_id") == F.col(f"__doc.{id_field}")) & bare
    ).select("job_id", "document")


def read_job_documents(spark: SparkSession, root: str, kind: str) -> DataFrame:
    return job_documents(read_document_texts(spark, root, kind), kind)


def read_progress_log(spark: SparkSession, path: str) -> DataFrame:
    """Progress logs, one file per job: ``job_id, chunk, line_no, line``.

    Lines keep file order: the block start orders blocks of a split file, the row id orders
    lines inside one. ``chunk`` feeds the chunked scans of block assembly.
    """
    rows = spark.read.text(path).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("job_id"),
        F.col("_metadata.file_block_start").alias("chunk"),
        F.monotonically_increasing_id().alias("__row"),
        F.col("value").alias("line"),
    )
    return rows.select(
        "job_id", "chunk", F.struct("chunk", F.col("__row")).alias("line_no"), "line"
    )


def scan_intake(spark: SparkSession, path: str) -> DataFrame:
    """Raw files as ``path, size_bytes, executable``; four bytes of each are read.

    Empty files are listed with size 0 and are not executable.
    """
    heads = with_bytes(list_files(spark, path), path, HEAD_BYTES)
    return classify_headers(heads.withColumnRenamed("size_bytes", "length"))


def quarantine(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split a scan into (clean, executable)."""
    return scanned.filter(~F.col("executable")), scanned.filter("executable")
