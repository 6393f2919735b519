"""Stages that turn raw documents into an encoded training corpus.

Each stage takes (spark, docs, sf_dir) and gets all that its predecessor kept; all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelyard.llm import bpe, jaccard_join, line_dedup, mixing, quality
from reelyard.llm.tables import stored
from reelyard.session import tune


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by their importance weight; the others go."""
    labels = tune(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return quality.selected(docs, labels)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier one holds; a document may lose all its text."""
    tune(spark)
    done = line_dedup.dedup_lines(docs)
    return done.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("kept_text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    tune(spark)
    return jaccard_join.one_per_group(docs, size=5, similarity=(80, 100))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in random order."""
    tune(spark)
    return mixing.mix(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, and a digest of the text that they decode to."""
    tune(spark)
    done = bpe.encode(docs.select("doc_id", "text", "lang", "source"), decoded=True)
    return done.select(
        "doc_id", "lang", "source", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), "token_ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality_sample", select_quality),
    ("line_dedup", drop_lines),
    ("jaccard_join", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("bpe", encode),
]

#: The models, set similarities and merges of the stages have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written and read again.

    The digest of the decoded texts stays in the table of the last stage.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs.drop("decoded_sha256")
