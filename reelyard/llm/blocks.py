"""Blocks: consecutive documents as one row of packed columns.

A block holds the keys of its documents, their numbers of words, and their words as numbers
into the block's list of distinct word hashes. Operators that count n-grams of the whole
corpus send each block's distinct n-grams to hash buckets, get the corpus counts back in the
same order and join them to the block. An n-gram that stands in all documents is one entry
for each block, so no key is larger than the number of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import U, Words, pieces, runs_of_words

#: Pieces of text (see ``texts``) in a block.
BLOCK_PIECES = 8
#: Words whose n-grams share a bucket, on average.
BUCKET_WORDS = 1_000_000


def planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight side by side: high bytes are mostly zero and pack well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def from_planes(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    return planes(np.diff(x, prepend=U(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, np.uint64), dtype=U)


def range_slices(keys: np.ndarray, buckets: int, bits: int) -> Iterator[tuple[int, slice]]:
    """Non-empty buckets of sorted keys below ``2 ** bits``, dealt out by equal ranges.

    Takes time in proportion to the keys, whatever the number of buckets.
    """
    if not len(keys):
        return
    width = min(bits, 32)
    bucket = ((keys >> U(bits - width)) * U(buckets) >> U(width)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1])
    for i, j in zip(first, [*first[1:], len(keys)]):
        yield int(bucket[i]), slice(int(i), int(j))


def make_blocks(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks of ``docs``, which has ``text`` and the 64-bit columns ``keys``.

    Store the result before its block numbers are used: they depend on the partitioning.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held = TaskContext.get().partitionId(), 0, []

        def one_list(values: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

        def block() -> pa.RecordBatch:
            sizes = np.concatenate([h[1] for h in held]).astype(np.int32)
            vocabulary, words = np.unique(np.concatenate([h[2] for h in held]), return_inverse=True)
            ids = [one_list(pa.concat_arrays([h[0][i] for h in held])) for i in range(len(keys))]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 32) + number]), *ids, one_list(pa.array(sizes)),
                    pa.array([pack_sorted(vocabulary)], pa.binary()), pa.array([planes(words.astype(np.uint32))], pa.binary()),
                ],
                ["block", *keys, "sizes", "vocabulary", "words"],
            )

        for batch in batches:
            for piece in pieces(batch, "text"):
                words = Words(piece.column("text"))
                held.append(([piece.column(k) for k in keys], np.diff(words.first), words.hashes))
                if len(held) == BLOCK_PIECES:
                    yield block()
                    number, held = number + 1, []
        if held:
            yield block()

    schema = ", ".join(["block long", *[f"{k} array<long>" for k in keys], "sizes array<int>, vocabulary binary, words binary"])
    return docs.select(*keys, "text").mapInArrow(run, schema)


def word_total(blocks: DataFrame) -> int:
    return blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0


class Block:
    """Words of a block: ``words[first[i] : first[i + 1]]`` are the hashes of document ``i``."""

    def __init__(self, row: dict):
        self.sizes = np.array(row["sizes"], np.int64)
        self.first = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.sizes)])
        self.words = unpack_sorted(row["vocabulary"])[from_planes(row["words"], np.uint32)]
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        return runs_of_words(self.words, self.first, size)
