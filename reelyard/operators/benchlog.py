"""Benchmark log reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import fixed, share
from ..session import materialize
from .running import CHUNK_ROWS, running


def stage_totals(log: DataFrame) -> DataFrame:
    """Elapsed time per run, case and stage, passes summed (``elapsed_us`` integers)."""
    return log.groupBy("benchmark", "case_id", "stage").agg(
        F.sum("elapsed_us").alias("elapsed_us"), F.count(F.lit(1)).alias("passes")
    )


def benchmark_matrix(log: DataFrame, runs: list[str]) -> DataFrame:
    """Case and stage by run, in milliseconds. The run names are given: no extra pass."""
    pivoted = log.groupBy("case_id", "stage").pivot("benchmark", runs).agg(F.sum("elapsed_us"))
    return pivoted.select(
        "case_id", "stage", *[fixed(F.col(f"`{r}`") / 1000, 3).alias(f"{r}_ms") for r in runs]
    )


def compare_runs(log: DataFrame, first: str, second: str) -> DataFrame:
    """Same case and stage in two runs, with saved time and percent.

    One conditional aggregation instead of a self join.
    """
    def total(run: str) -> Column:
        return F.sum(F.when(F.col("benchmark") == run, F.col("elapsed_us")))

    both = (
        log.filter(F.col("benchmark").isin(first, second))
        .groupBy("case_id", "stage")
        .agg(total(first).alias("a"), total(second).alias("b"))
    )
    saved = F.col("a") - F.col("b")
    return both.select(
        "case_id", "stage",
        fixed(F.col("a") / 1000, 3).alias("first_ms"),
        fixed(F.col("b") / 1000, 3).alias("second_ms"),
        fixed(saved / 1000, 3).alias("saved_ms"),
        F.when(F.col("a") > 0, fixed(share(saved, F.col("a")) * 100, 1)).alias("saved_percent"),
    )


def stage_summary(
    log: DataFrame, percent: int = 95, bucket_us: int = 1 << 20, size: int = CHUNK_ROWS
) -> DataFrame:
    """Rows, errors, mean and exact percentile (nearest rank) of each stage.

    ``log``: stage, elapsed_us, failed. A stage may hold a third of all rows, so its values
    are never gathered: equal values are counted, counts are scanned in value buckets, and
    the first value whose running count reaches the rank is the percentile.
    """
    # one pass over the log; everything else reads one row per stage and value
    values = materialize(
        log.groupBy("stage", "elapsed_us").agg(F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("failures")),
        "stage-values",
    )
    totals = values.groupBy("stage").agg(
        F.sum("n").alias("rows"),
        F.sum("failures").alias("errors"),
        F.coalesce(F.sum(F.when(F.col("elapsed_us").isNotNull(), F.col("n"))), F.lit(0)).alias("measured"),
        F.sum(F.col("elapsed_us") * F.col("n")).alias("elapsed_us"),
    )
    counts = values.filter(F.col("elapsed_us").isNotNull()).select("stage", "elapsed_us", "n")
    ranked = running(
        counts, ["stage"], ["elapsed_us"], {"reached": ("sum", F.col("n"), True)},
        chunk=F.floor(F.col("elapsed_us") / bucket_us), size=size,
    )
    needed = F.floor((F.col("measured") * percent + 99) / 100)
    goals = totals.select(F.col("stage").alias("__of"), needed.alias("__needed"))
    tail = (
        ranked.join(goals, F.col("stage").eqNullSafe(F.col("__of")))
        .filter(F.col("reached") >= F.col("__needed"))
        .groupBy("__of")
        .agg(F.min("elapsed_us").alias("__value"))
    )
    return totals.join(tail, F.col("stage").eqNullSafe(F.col("__of")), "left").select(
        "stage", "rows", "errors",
        fixed(share(F.col("elapsed_us"), F.col("measured")) / 1000, 3).alias("mean_ms"),
        fixed(F.col("__value") / 1000, 3).alias(f"p{percent}_ms"),
    )
