"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join even where that costs the next operator one more shuffle:
    # one job or file may hold a third of all rows.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings every operator relies on."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("reelyard")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("WARN")
    return tune(spark)


@cache
def local_root() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, the folder that all executors share.

    Only where the setting is missing and driver and executors are one machine, as in tests,
    a temporary folder of the process takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or (local_root() if spark.conf.get("spark.master", "").startswith("local") else None)
    if not root:
        raise RuntimeError("start the session with spark.checkpoint.dir naming a folder all executors share")
    return f"{root.rstrip('/')}/reelyard/{purpose}-{uuid.uuid4().hex}"


#: Folders of the open ``scratch`` blocks, innermost last.
_scratch: list[list[str]] = []


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    For inputs that several branches of a job scan: the lineage is cut, nothing is kept
    in executor memory, and a lost executor costs only its running tasks.
    """
    path = shared_dir(df.sparkSession, purpose)
    if _scratch:
        _scratch[-1].append(path)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_path = path
    return table


def forget(*tables: DataFrame) -> None:
    """Remove tables of ``materialize`` that nothing will read any more."""
    for table in tables:
        path = getattr(table, "stored_path", None)
        if path:
            remove(table.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder; where the session has no file system at hand, leave it without rows."""
    jvm = getattr(spark, "_jvm", None)
    if jvm is None:
        spark.range(0).write.mode("overwrite").parquet(path)
        return
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession, *, keep: Callable[[], DataFrame | None] = lambda: None) -> Iterator[None]:
    """Remove all tables that ``materialize`` writes inside the block when it ends.

    ``keep()`` names a table that stays; results that still read the others must be written
    inside the block.
    """
    mine: list[str] = []
    _scratch.append(mine)
    try:
        yield
    finally:
        _scratch.remove(mine)
        kept = getattr(keep(), "stored_path", None)
        for path in mine:
            if path != kept:
                remove(spark, path)
        if kept in mine and _scratch:
            _scratch[-1].append(kept)
