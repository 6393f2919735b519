"""Mixing of sources to target weights by Poisson replication.

A source that holds a share ``a`` of all characters and should have a share ``t`` repeats
each of its documents ``t / a * size`` times on average. The number of copies of one document
is a Poisson variable with that mean, got by inverting the distribution at a number in [0, 1)
that is a hash of the seed and the document id: no state, the same copies on every run and
whatever the partitioning. Copies are then shuffled over all partitions by another hash.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import packed, text_of, unpacked

SEED = "mix-1"
#: A source's documents are spread over so many parts of the join with the source table.
SPREAD = 64
#: Above this mean the terms of the sum would underflow; such means are split into equal parts.
MOST_MEAN = 500.0


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits, hashed from the parts."""
    digest = F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13)
    return F.conv(digest, 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def poisson_count(mean: Column, u: Column) -> Column:
    """Smallest k whose Poisson probabilities 0..k sum to more than ``u``; 0 for a null mean.

    The sum runs over ``mean + 12 sqrt(mean) + 25`` terms, beyond which doubles add nothing.
    """
    safe = F.least(F.coalesce(mean, F.lit(0.0)), F.lit(MOST_MEAN))
    terms = F.sequence(F.lit(1), (safe + F.sqrt(safe) * 12 + 25).cast("int"))
    start = F.struct(
        F.lit(0).alias("k"), F.exp(-safe).alias("p"), F.exp(-safe).alias("below")
    )

    def step(acc: Column, i: Column) -> Column:
        p = acc["p"] * safe / i
        more = acc["below"] <= u
        return F.struct(
            F.when(more, i).otherwise(acc["k"]).alias("k"),
            p.alias("p"), F.when(more, acc["below"] + p).otherwise(acc["below"]).alias("below"),
        )

    return F.aggregate(terms, start, step, lambda acc: acc["k"])


def source_means(
    docs: DataFrame, weights: Mapping[str | None, float] | None = None, size: float = 1.0
) -> DataFrame:
    """One row per source: its characters, its target share and the mean number of copies.

    Without ``weights`` every source gets a share in proportion to the square root of its
    characters, which lifts small sources. Weights need not sum to one; sources without a
    weight get no copies. ``size`` is the size of the mixture relative to the input. Sources
    without any character have no copies. The null source is a source of its own.
    """
    sizes = docs.groupBy("source").agg(F.sum(F.length(text_of())).cast("double").alias("chars"))
    if weights is None:
        weight = F.sqrt("chars")
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), float(w)).otherwise(weight)
    sizes = sizes.withColumn("weight", weight)
    total = sizes.agg(F.sum("chars").alias("all_chars"), F.sum("weight").alias("all_weight"))
    sizes = sizes.join(F.broadcast(total), F.lit(True), "left")  # a single row
    share = F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight"))
    return sizes.select(
        "source", "chars", share.alias("share"),
        F.when(F.col("chars") > 0, share * F.col("all_chars") * size / F.col("chars")).alias("mean"),
    )


def copies(
    docs: DataFrame, weights: Mapping[str | None, float] | None = None, size: float = 1.0, seed: str = SEED
) -> DataFrame:
    """``docs`` with ``mean``, ``copies`` and no row left out.

    The source table is joined by (source, part): a document's part is a hash of its id, so
    a source that holds a third of all rows is spread over ``SPREAD`` keys.
    """
    means = source_means(docs.select("source", "text"), weights, size).select(
        F.col("source").alias("of"), "mean", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("in_part"),
    )
    part = F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD)).cast("int")
    base = packed(docs, F.col("source"), F.col("doc_id"), part.alias("part"))
    joined = base.join(means, (base["part"] == means["in_part"]) & base["source"].eqNullSafe(means["of"]), "left")
    mean = F.coalesce(F.col("mean"), F.lit(0.0))
    # a sum of independent Poisson variables is one: means beyond MOST_MEAN are drawn in parts
    parts = F.greatest(F.ceil(mean / MOST_MEAN), F.lit(1)).cast("int")
    draws = F.transform(
        F.sequence(F.lit(1), parts),
        lambda i: poisson_count(mean / parts, uniform(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), i.cast("string"))),
    )
    count = F.aggregate(draws, F.lit(0), lambda a, x: a + x)
    kept = [c for c in docs.columns if c not in ("mean", "copies")]
    return joined.select(*unpacked(kept), mean.alias("mean"), count.alias("copies"))


def mix(
    docs: DataFrame, weights: Mapping[str | None, float] | None = None, size: float = 1.0, seed: str = SEED
) -> DataFrame:
    """The mixture: every document as often as it was drawn, shuffled globally.

    Adds ``mean``, ``copy`` (from 1) and ``position``, a random number in [0, 1) by which the
    rows are range-partitioned and sorted. Rows that repeat a doc_id are drawn alike.
    Null and empty texts belong to their source with no characters.
    """
    drawn = copies(docs.drop("copy", "position"), weights, size, seed).where("copies > 0")
    drawn = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")
    key = uniform(F.lit(seed), F.lit("order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("copy").cast("string"))
    # positions are uniform, so equal ranges of them are equal parts and nothing is sampled or drawn twice
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = drawn.withColumn("position", key)
    return placed.repartitionById(parts, F.floor(F.col("position") * parts).cast("int")).sortWithinPartitions("position", "doc_id", "copy")


def digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The mixed documents, whole texts included."""
    return mix(docs.select("doc_id", "text", "lang", "source", "n_chars")).select(
        "doc_id", "text", "lang", "source", "n_chars", "copy", F.round("mean", 6).alias("mean"), "position"
    )
