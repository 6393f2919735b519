"""Quality selection by importance resampling on hashed n-grams.

Two generative models are fitted on hashed n-grams: one of the raw corpus, over all its
documents, and one of the target, over a bounded sample of documents labelled good. The
logarithm of a document's importance weight is the sum of ``log(p_target / p_raw)`` over its
n-grams. Adding Gumbel noise and taking the ``k`` largest sums draws ``k`` documents without
replacement in proportion to their weights. The noise is a hash of the document id.

N-grams are runs of one and two words, and runs of one to four word shapes: a shape holds the
kinds of the first and last byte, the length and whether the word repeats the one before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .mixing import uniform
from .tables import packed, stored, text_of, unpacked
from .texts import U, Words, mix, pieces

#: Hash buckets of the models, as a power of two; the models' size doesn't grow.
BITS = 14
#: Labelled documents that the target model is fitted on, at most.
LABELLED = 20_000
#: Pseudo-counts per bucket that draw the target model towards the raw one.
SHRINK = 20.0
SEED = "quality-1"
SHAPE_RUNS = 4

_KIND = np.full(256, 3, np.uint8)  # bytes of characters beyond ASCII
_KIND[:128] = 2
_KIND[ord("0") : ord("9") + 1] = 1
_KIND[ord("a") : ord("z") + 1] = 0


def n_grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of every n-gram of some texts."""
    words = Words(texts)
    doc = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    h = words.hashes
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    length = np.minimum(words.ends - words.starts, 15)
    shape = (_KIND[words.data[words.starts]] * 4 + _KIND[words.data[words.ends - 1]]).astype(np.int64) * 16 + length
    shape[1:] += 256 * ((h[1:] == h[:-1]) & (doc[1:] == doc[:-1]))
    found, owner = [mix(h + U(1))], [doc]
    two = doc[1:] == doc[:-1]
    found.append(mix(h[:-1] * U(3) + h[1:] + U(2))[two])
    owner.append(doc[1:][two])
    run = shape.astype(U)
    for size in range(1, SHAPE_RUNS + 1):
        if size > 1:
            run = run[:-1] * U(1024) + shape[size - 1 :].astype(U)
        whole = doc[size - 1 :] == doc[: len(doc) - size + 1]
        found.append(mix(run + (U(size) << U(56)))[whole])
        owner.append(doc[size - 1 :][whole])
        if len(run) < 2:
            break
    return (np.concatenate(found) >> U(64 - BITS)).view(np.int64), np.concatenate(owner)


def held_out() -> F.Column:
    """Every other labelled document, by a hash of its id."""
    return F.pmod(F.xxhash64(F.lit("held out"), "doc_id"), F.lit(2)) == 0


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, shrink: float = SHRINK) -> np.ndarray:
    """``log(p_target / p_raw)`` of every bucket.

    ``labels(doc_id, quality, toxic)``: good are rows of quality 1 that are not toxic. The
    ``labelled`` of them with the smallest hash of the id make the target sample; those that
    ``held_out`` names are left to find the cut. Without any good document all ratios are 0.
    """
    good = labels.where("doc_id is not null and quality = 1 and coalesce(toxic, 0) = 0").select("doc_id").distinct()
    good = good.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    target = F.broadcast(good.select(F.col("doc_id").alias("_good")))  # at most ``labelled`` ids
    flagged = docs.select("doc_id", text_of().alias("text")).join(target, F.col("doc_id") == F.col("_good"), "left")
    flagged = flagged.select("text", F.col("_good").isNotNull().alias("good"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for piece in pieces(batch, "text"):
                bucket, owner = n_grams(piece.column("text"))
                raw += np.bincount(bucket, minlength=len(raw))
                good = piece.column("good").to_numpy(zero_copy_only=False).astype(bool)
                target += np.bincount(bucket[good[owner]], minlength=len(raw))
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (used.astype(np.int32), raw[used], target[used])], ["bucket", "raw", "target"])

    rows = flagged.mapInArrow(count, "bucket int, raw long, target long")
    held = rows.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()  # at most 2 ** BITS rows
    raw, target = np.zeros(1 << BITS), np.zeros(1 << BITS)
    raw[held["bucket"].to_numpy()] = held["raw"].to_numpy()
    target[held["bucket"].to_numpy()] = held["target"].to_numpy()
    if not target.sum():
        return np.zeros(1 << BITS)
    p = (raw + 0.5) / (raw + 0.5).sum()
    pseudo = shrink * len(p)
    return np.log((target + pseudo * p) / (target.sum() + pseudo)) - np.log(p)


def scored(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """``docs`` with ``log_ratio``; a text without words has 0. A column of that name is replaced."""
    kept = [f for f in docs.schema.fields if f.name != "log_ratio"]
    names = [f.name for f in kept]
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                bucket, owner = n_grams(piece.column("text"))
                total = np.bincount(owner, weights=shared.value[bucket], minlength=piece.num_rows)
                yield pa.RecordBatch.from_arrays([*(piece.column(n) for n in names), pa.array(total)], [*names, "log_ratio"])

    return docs.select(*names).mapInArrow(run, T.StructType([*kept, T.StructField("log_ratio", T.DoubleType())]))


def gumbel_key(seed: str = SEED):
    """Log weight plus Gumbel noise, a hash of the document id."""
    u = uniform(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    return F.col("log_ratio") - F.log(-F.log((u * F.lit(float((1 << 52) - 1)) + 0.5) / float(1 << 52)))


def kth_largest(values: DataFrame, k: int, bins: int = 1024, small: int = 10_000) -> float:
    """The ``k`` -th largest of the column ``key``, by histograms that narrow to one bin."""
    low, high, left = *values.agg(F.min("key"), F.max("key")).first(), k
    if low is None or k <= 0:
        return float("inf")
    while low < high:
        width = (high - low) / bins
        within = values.where((F.col("key") >= low) & (F.col("key") <= high))
        number = F.least(F.floor((F.col("key") - low) / width), F.lit(bins - 1))
        rows = within.groupBy(number.alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b")).collect()  # at most ``bins`` rows
        for row in sorted(rows, key=lambda r: -r["bin"]):
            if row["n"] >= left:
                break
            left -= row["n"]
        else:
            return row["a"]  # fewer than k values in all
        if row["n"] <= small:
            part = within.where((F.col("key") >= row["a"]) & (F.col("key") <= row["b"]))
            return part.orderBy(F.desc("key")).limit(left).agg(F.min("key")).first()[0]
        if (row["a"], row["b"]) == (low, high):
            break
        low, high = row["a"], row["b"]
    return low


def share_of_good(keys: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> float:
    """Log weight that parts good from bad best: the lowest one with the fewest errors.

    Errors are the shares of good and of bad documents on the wrong side, over ``labelled``
    held-out ids of each kind at most; an id of several rows counts once, with its lowest weight.
    Without bad rows nothing is rejected.
    """
    marks = labels.where("doc_id is not null and quality is not null").where(held_out()).groupBy("doc_id").agg(F.min("quality").alias("good"))
    kinds = [marks.where(F.col("good") == x).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled) for x in (0, 1)]
    marks = kinds[0].unionByName(kinds[1])
    rows = keys.join(F.broadcast(marks), "doc_id").groupBy("doc_id").agg(F.min("log_ratio").alias("log_ratio"), F.min("good").alias("good"))
    rows = rows.select("log_ratio", "good").toArrow()  # one row per id, bounded by ``labelled``
    score, good = rows["log_ratio"].to_numpy(), rows["good"].to_numpy() == 1
    if good.all() or not good.any():
        return -np.inf
    sort = np.argsort(score, kind="stable")
    score, good = score[sort], good[sort]
    lost = np.concatenate([[0], np.cumsum(good)]) / good.sum()
    passed = np.concatenate([[0], np.cumsum(~good)])
    passed = (passed[-1] - passed) / passed[-1]
    at = int(np.argmin(lost + passed))
    return float(score[at]) if at < len(score) else np.inf


def cut_of(
    docs: DataFrame, labels: DataFrame, ratios: np.ndarray, k: int | None = None, seed: str = SEED,
    labelled: int = LABELLED,
) -> tuple[DataFrame, float]:
    """Keys of all documents, and the smallest key that is drawn.

    Without ``k`` as many documents are drawn as have a weight like that of good documents.
    """
    keys = scored(docs.select(F.col("doc_id"), text_of().alias("text")), ratios).select("doc_id", "log_ratio")
    keys = stored(keys.withColumn("key", gumbel_key(seed)), "quality-keys")
    if k is None:
        k = keys.where(F.col("log_ratio") >= share_of_good(keys, labels, labelled)).count()
    return keys, kth_largest(keys.select("key"), k)


def sample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: str = SEED, labelled: int = LABELLED) -> DataFrame:
    """The drawn rows of ``docs(doc_id, text)``: ``doc_id, log_ratio, key``.

    Null and empty texts have weight 1. Rows tied at the smallest drawn key all stay, so rows
    that repeat id and text stay or go together.
    """
    keys, cut = cut_of(docs, labels, fit(docs, labels, labelled), k, seed, labelled)
    return keys.where(F.col("key") >= cut)


def selected(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: str = SEED, labelled: int = LABELLED) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns; texts are scored again, not moved."""
    ratios = fit(docs, labels, labelled)
    _, cut = cut_of(docs, labels, ratios, k, seed, labelled)
    rows = packed(docs, F.col("doc_id"), text_of().alias("text"))
    return scored(rows, ratios).where(gumbel_key(seed) >= cut).select(*unpacked(docs.columns))


def digest(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that the registered query returns."""
    return sample(docs.select("doc_id", "text"), labels)
