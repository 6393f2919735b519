"""Table helpers of the operators: stable row keys, free column names and stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def text_of(name: str = "text") -> Column:
    """The text column, null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def text_key(name: str = "text") -> Column:
    """A 64-bit key of the text. With the document id it names a row across scans.

    Rows equal in both are the same to every operator, so a repeated row needs no key of
    its own, and the key doesn't depend on how a scan is split.
    """
    return F.xxhash64(text_of(name))


def wide_hash(column: Column) -> list[Column]:
    """Two independent 64-bit hashes, together a 128-bit key."""
    return [F.xxhash64(column).alias("h1"), F.xxhash64(F.lit(7), column).alias("h2")]


def on_row(left: DataFrame, right: DataFrame) -> Column:
    """Join condition on document id (null equals null) and text key."""
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["text_key"] == right["text_key"])


#: Spark then removes the shuffle files of a query when the query ends, not some time later.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder of the session and read it back.

    What the write shuffled is of no further use and goes at once, so a job of many such
    steps never holds the shuffles of more than one.
    """
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return materialize(df, f"llm-{purpose}")
    finally:
        if before is None:
            conf.unset(CLEANUP)
        else:
            conf.set(CLEANUP, before)


def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """All columns of ``docs`` as one struct ``row``, and the columns ``more``.

    What an operator adds can then have any name without clashing with the caller's columns.
    """
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *more)


def unpacked(columns: list[str]) -> list[Column]:
    return [F.col("row").getField(c).alias(c) for c in columns]
