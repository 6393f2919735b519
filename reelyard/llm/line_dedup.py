"""Removal of lines that an earlier document already holds, against levelled sorted runs.

Lines are known by a 128-bit hash of their key: the line with ``[\\x20\\x09-\\x0D]`` stripped
at both ends and A-Z lower-cased. All known keys lie in *runs*: tables of distinct hashes,
bucketed and sorted by hash, so that a new batch is merged with them without moving them.
A batch is anti-joined with each run; what is left becomes a new run of level 0, and as soon
as a level has ``fanout`` runs they are merged into one run of the next level. A key is
therefore rewritten once per level, and a batch reads ``fanout * levels`` runs at most.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from .tables import packed, stored, text_key, text_of, unpacked, wide_hash

SPACES = "\t\n\x0b\x0c\r "
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
KEY = ["h1", "h2"]
MIN_CHARS = 10
FANOUT = 2
#: Batches and buckets, and the lines from which there are more of them.
BATCHES, BATCH_LINES = 3, 1 << 32
BUCKETS, BUCKET_LINES = 32, 4_000_000


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, UPPER.lower())


class LineRuns:
    """The levelled runs of one deduplication; ``levels[i]`` lists the tables of level ``i``."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int = BUCKETS):
        self.spark, self.fanout, self.buckets = spark, fanout, buckets
        self.levels: list[list[str]] = []

    def tables(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The keys that no run holds."""
        return reduce(
            lambda left, name: left.join(self.spark.table(name).select(*KEY), KEY, "left_anti"),
            self.tables(), keys,
        )

    def add(self, keys: DataFrame) -> str:
        """Write keys that no run holds as a run of level 0; compact the levels that are full."""
        name = self._write(keys)
        self._place(name, 0)
        return name

    def close(self) -> None:
        """Forget the runs; their files belong to the shared folder."""
        for name in self.tables():
            self.spark.sql(f"drop table if exists {name}")
        self.levels = []

    def _place(self, name: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            merged = self._write(reduce(DataFrame.unionByName, [self.spark.table(n) for n in full]))
            for old in full:
                self.spark.sql(f"drop table {old}")
            self._place(merged, level + 1)

    def _write(self, keys: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (
            keys.select(*KEY).repartition(self.buckets, *KEY)
            .write.bucketBy(self.buckets, *KEY).sortBy(*KEY)
            .option("path", shared_dir(self.spark, "line-run")).saveAsTable(name)
        )
        return name


def batch_of(docs: DataFrame, batches: int) -> Column:
    """Number of the batch of a document: equal shares in the order of doc_id, null ids last."""
    at = [i / batches for i in range(1, batches)]
    cuts = docs.agg(F.percentile_approx("doc_id", at, 1000).alias("cuts")).first()["cuts"] if at else None
    number = F.lit(0)
    for cut in cuts or []:
        number = number + (F.col("doc_id") > cut).cast("int")
    return F.when(F.col("doc_id").isNull(), batches).otherwise(number)


def dropped_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, batches: int | None = None, fanout: int = FANOUT
) -> DataFrame:
    """Numbers (from 1) of the lines to drop, one row per document that loses any.

    A line goes if its key has at least ``min_chars`` code points and a document with a
    smaller id holds it. Null ids are one document that comes last. Batches are ranges of
    doc_id, so what the runs hold always stands in an earlier document.
    """
    spark = docs.sparkSession
    keys = F.posexplode(F.split(text_of(), "\n", -1)).alias("pos", "line")
    lines = docs.select("doc_id", text_key().alias("text_key"), keys)
    lines = lines.select("doc_id", "text_key", (F.col("pos") + 1).alias("pos"), line_key(F.col("line")).alias("key"))
    lines = lines.where(F.length("key") >= min_chars)
    lines = stored(lines.select("doc_id", "text_key", "pos", *wide_hash(F.col("key"))), "lines")
    total = lines.count()
    batches = batches or max(BATCHES, -(-total // BATCH_LINES))
    runs = LineRuns(spark, fanout, max(BUCKETS, -(-total // BUCKET_LINES)))
    lines = lines.withColumn("batch", batch_of(docs, batches))
    parts = []
    for number in range(batches + 1):
        part = lines.where(F.col("batch") == number)
        # one row per key before anything is joined: a line that fills a third of all
        # documents is a single row here
        keys = stored(
            part.groupBy(*KEY).agg(
                F.min("doc_id").alias("first"),
                (F.min("doc_id") != F.max("doc_id")).alias("shared"),
                (F.count("doc_id") < F.count("*")).alias("unnamed"),
            ), "line-keys",
        )
        new = stored(runs.unseen(keys).select(*KEY), "line-new")
        old = keys.join(new, KEY, "left_anti").select(*KEY, F.lit(None).cast("bigint").alias("first"))
        first = keys.where("shared or (unnamed and first is not null)").join(new, KEY, "left_semi")
        owner = stored(old.unionByName(first.select(*KEY, F.col("first").cast("bigint"))), "line-owners")
        hit = part.join(owner, KEY).where(F.col("first").isNull() | ~F.col("doc_id").eqNullSafe(F.col("first")))
        # identical rows repeat their lines; a set keeps a number once
        drops = hit.groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias("drop"))
        parts.append(stored(drops, "line-drops"))
        if number < batches:
            runs.add(new)
    runs.close()
    return reduce(DataFrame.unionByName, parts)


def dedup_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, batches: int | None = None, fanout: int = FANOUT
) -> DataFrame:
    """All rows and columns of ``docs`` with ``n_lines``, ``n_dropped`` and the text kept.

    Texts are split at ``\\n``; a null or empty text is one empty line. A text that loses
    nothing is returned as it is (null as empty); one that loses all its lines is empty.
    Needs ``doc_id`` and ``text``; other columns pass through, whatever their names, except
    that ``n_lines``, ``n_dropped`` and ``kept_text`` are replaced.
    """
    drops = dropped_lines(docs.select("doc_id", "text"), min_chars, batches, fanout)
    drops = drops.select(F.struct("doc_id", "text_key").alias("key"), "drop")
    own = F.struct(F.col("doc_id"), text_key().alias("text_key"))
    joined = packed(docs, own.alias("key"), text_of().alias("text")).join(drops, "key", "left")
    lines = F.split("text", "\n", -1)
    left = F.array_except(F.sequence(F.lit(1), F.size(lines)), F.col("drop"))
    kept = F.array_join(F.transform(left, lambda i: F.element_at(lines, i)), "\n")
    return joined.select(
        *unpacked([c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")]),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("drop").isNull(), F.col("text")).otherwise(kept).alias("kept_text"),
    )


def digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows that the registered query returns."""
    return dedup_lines(docs.select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256")
    )
