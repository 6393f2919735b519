"""Stupid-backoff scores of all documents under the n-gram counts of all other documents.

Three relations, all partitioned by hash:

* ``blocks``: consecutive documents as one row, their words as numbers into the block's list
  of distinct word hashes;
* ``grams``: the distinct n-grams of a block as whole 64-bit hashes with their counts, exploded by hash bucket; the
  count table of a bucket is their sum, which is joined back to every block's n-grams;
* ``totals``: for each block and bucket the corpus counts of its n-grams, in hash order,
  joined to the block, where every document sums the logarithms of its words' scores.

Columns of a block travel as packed arrays (see ``blocks``). Whole documents are counted, and
what is counted grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import BUCKET_WORDS, Block, from_planes, make_blocks, pack_sorted, planes, range_slices, unpack_sorted, word_total
from .tables import stored, text_of
from .texts import U, mix

ORDER = 2
BACKOFF = 0.4

class LmBlock(Block):
    def grams_and_ends(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of ``order`` words in a document, and the place of their last word."""
        last = np.arange(order - 1, len(self.words))
        last = last[self.doc[last] == self.doc[last - order + 1]]
        h = mix(self.words[last - order + 1] + U(order))
        for k in range(order - 2, -1, -1):
            h = mix(h * U(3) + self.words[last - k])
        return h, last


def _bucket_rows(row: dict, order: int, buckets: int) -> Iterator[dict]:
    block = LmBlock(row)
    for k in range(1, order + 1):
        grams, counts = np.unique(block.grams_and_ends(k)[0], return_counts=True)
        for b, at in range_slices(grams, buckets, 64):
            yield {
                "block": row["block"], "size": k, "bucket": b, "grams": pack_sorted(grams[at]),
                "counts": planes(counts[at].astype(np.uint32)),
            }


GRAMS = pa.schema([("block", pa.int64()), ("size", pa.int32()), ("bucket", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary())])
TOTALS = pa.schema([("block", pa.int64()), ("size", pa.int32()), ("bucket", pa.int32()), ("totals", pa.binary())])
SCORES = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_backed_off", pa.int64()), ("log_score", pa.float64())])


def count_bucket(table: pa.Table) -> pa.Table:
    """The count table of a bucket, joined to the n-grams of every block."""
    parts = [unpack_sorted(x) for x in table["grams"].to_pylist()]
    counts = np.concatenate([from_planes(x, np.uint32) for x in table["counts"].to_pylist()]).astype(np.int64)
    grams, at = np.unique(np.concatenate(parts), return_inverse=True)
    totals = np.bincount(at, weights=counts, minlength=len(grams)).astype(np.uint64)[at]
    cuts = np.cumsum([len(p) for p in parts])[:-1]
    return pa.Table.from_arrays(
        [table["block"], table["size"], table["bucket"], pa.array([planes(t) for t in np.split(totals, cuts)], pa.binary())],
        schema=TOTALS,
    )


def score_block(row: dict, totals: list[dict], order: int, corpus: int, backoff: float) -> list[dict]:
    """Scores of the documents of a block, their own words not counted."""
    block = LmBlock(row)
    n = len(block.words)
    others: dict[int, np.ndarray] = {}
    for k in range(1, order + 1):
        grams, last = block.grams_and_ends(k)
        unique, at = np.unique(grams, return_inverse=True)
        parts = sorted((t for t in totals if t["size"] == k), key=lambda t: t["bucket"])  # ranges, in order
        total = np.concatenate([from_planes(t["totals"], np.uint64) for t in parts] or [np.zeros(0, U)]).astype(np.int64)
        pair = block.doc[last] * (len(unique) + 1) + at
        _, own, times = np.unique(pair, return_inverse=True, return_counts=True)
        others[k] = np.zeros(n, np.int64)
        others[k][last] = total[at] - times[own]
    rest = corpus - block.sizes[block.doc]
    score = np.log((others[1] + 1) / (rest + 1))
    backed = np.zeros(n, bool)
    for k in range(2, order + 1):
        context = np.zeros(n, np.int64)
        context[1:] = others[k - 1][:-1]
        place = np.zeros(n, np.int64)
        place[k - 1 :] = block.doc[k - 1 :] == block.doc[: n - k + 1] if n >= k else 0
        seen = (others[k] > 0) & (context > 0)
        score = np.where(
            seen, np.log(np.maximum(others[k], 1) / np.maximum(context, 1)), score + np.where(place > 0, np.log(backoff), 0.0)
        )
        backed = np.where(place > 0, ~seen, backed)
    docs = len(block.sizes)
    sums = np.bincount(block.doc, weights=score, minlength=docs)
    off = np.bincount(block.doc, weights=backed, minlength=docs)
    return [
        {"doc_id": d, "n_words": int(s), "n_backed_off": int(o), "log_score": float(x)}
        for d, s, o, x in zip(row["doc_id"], block.sizes, off, sums)
    ]


def lm_scores(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """``doc_id, n_words, n_backed_off, log_score, mean_log_score``, one row per row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text with A-Z lower-cased. The score of a
    word after its ``k - 1`` predecessors is ``c(run) / c(predecessors)`` if the run occurs in
    another document, else ``backoff`` times the score with one predecessor less; the score of
    a word alone is ``(c(word) + 1) / (words of the other documents + 1)``. ``c`` counts in
    all other rows, so a repeated row is predicted by its copy. ``n_backed_off`` counts the
    words that their longest run didn't score. A null or empty text has no words, a sum of 0
    and no mean. Other columns are not read.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    blocks = stored(make_blocks(base, ["doc_id"]), "lm-blocks")
    corpus = word_total(blocks)
    buckets = int(corpus // BUCKET_WORDS) + 1

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                for row in _bucket_rows(batch.slice(i, 1).to_pylist()[0], order, buckets):
                    yield pa.RecordBatch.from_pylist([row], schema=GRAMS)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        return pa.Table.from_pylist(score_block(row, right.to_pylist(), order, corpus, backoff), schema=SCORES)

    grams = blocks.mapInArrow(explode, "block long, size int, bucket int, grams binary, counts binary")
    totals = grams.groupBy("size", "bucket").applyInArrow(count_bucket, "block long, size int, bucket int, totals binary")
    totals = stored(totals, "lm-totals")
    scored = blocks.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(
        score, "doc_id long, n_words long, n_backed_off long, log_score double"
    )
    return scored.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))


def digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows that the registered query returns."""
    return lm_scores(docs.select("doc_id", "text"))
