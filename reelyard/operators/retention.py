"""Expiry of results and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims


def retention_minutes(value: Column) -> Column:
    """An allowed retention, or the default."""
    return F.when(value.isin(*dims.RETENTION_CHOICES_MIN), value).otherwise(
        F.lit(dims.DEFAULT_RETENTION_MIN)
    )


def with_expiry(results: DataFrame, minutes: Column) -> DataFrame:
    """Add ``expires_at`` and the partition column ``created_date``."""
    return results.withColumns(
        {
            "expires_at": F.col("created_at")
            + F.make_dt_interval(mins=retention_minutes(minutes).cast("int")),
            "created_date": F.to_date("created_at"),
        }
    )


def active_results(results: DataFrame, now: Column, kind: str | None = None) -> DataFrame:
    """Unexpired results, of one kind if asked.

    Retention is at most an hour, so a result that is still active was created on the day
    of ``now`` or the day before: that bound on ``created_date`` prunes partitions.
    """
    rows = results
    if "created_date" in results.columns:
        rows = rows.filter(F.col("created_date") >= F.date_sub(F.to_date(now), 1))
    rows = rows.filter(F.col("expires_at") > now)
    return rows if kind is None else rows.filter(F.col("kind") == kind)


def expired_jobs(jobs: DataFrame, now: Column, active: DataFrame | None = None) -> DataFrame:
    """Jobs past their time to live, except the active ones.

    ``jobs``: job_id, last_modified, retention_min, failed. A failed job lives ten
    minutes at most.
    """
    minutes = retention_minutes(F.col("retention_min"))
    ttl = F.when(
        F.col("failed"), F.least(minutes, F.lit(dims.FAILED_RETENTION_MIN))
    ).otherwise(minutes)
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_modified").cast("timestamp"))
    expired = jobs.withColumn("ttl_min", ttl).filter(age > F.col("ttl_min").cast("bigint") * 60_000_000)
    if active is None:
        return expired
    return expired.join(active.select("job_id").distinct(), "job_id", "left_anti")
