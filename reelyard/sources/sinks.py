"""Table sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import attachment_header, normalize_names
from ..operators.logs import allowlist_logs
from ..operators.retention import with_expiry


def write_results(results: DataFrame, path: str, minutes: Column, mode: str = "append") -> None:
    """Write results by creation date with expiry and a header-safe download name.

    ``rebalance`` gathers each date for few, large files; AQE splits a busy date over many
    writers and packs quiet dates together.
    """
    rows = with_expiry(results, minutes)
    if "download_name" in results.columns:
        rows = normalize_names(rows, "download_name")
        rows = rows.withColumn("content_disposition", attachment_header(F.col("download_name")))
    rows.hint("rebalance", "created_date").write.mode(mode).partitionBy("created_date").parquet(path)


def write_logs(raw: DataFrame, path: str, mode: str = "append") -> None:
    """Write allowlisted log rows as JSON lines; null fields are left out."""
    allowlist_logs(raw).write.mode(mode).option("ignoreNullFields", True).json(path)
