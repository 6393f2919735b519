"""Document fingerprints: digests of bucket quartiles of hashed byte triplets.

Every byte forms three triplets with its predecessors; triplets are hashed into 256 buckets
and counted. The digest says for each bucket in which quartile of the counts it lies, and
holds the logarithm of the length and the ratios of the quartiles. Digests of similar texts
differ in few buckets. The difference is a sum of bounded parts, and likeness is
``1 - min(difference, MOST) / MOST``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import text_key, text_of
from .texts import pieces

BUCKETS = 256
#: Difference from which two texts are not alike at all.
MOST = 400
#: Cost of two, one or no quartiles between two buckets, and of all three.
STEPS = np.array([0, 1, 2, 6])
#: Rows in a range of document ids, and ranges, at most.
RANGE_ROWS = 4_000
MOST_RANGES = 10_000

#: Offsets of the two earlier bytes of each triplet, and an odd multiplier.
TRIPLETS = ((1, 2, 0x9E3779B1), (1, 3, 0x85EBCA6B), (2, 3, 0xC2B2AE35))


class Digest:
    """A fingerprint taken apart: length code, two quartile ratios and quartile codes."""

    __slots__ = ("size", "ratios", "codes")

    def __init__(self, size: int, ratios: tuple[int, int], codes: np.ndarray):
        self.size, self.ratios, self.codes = size, ratios, codes

    @classmethod
    def of(cls, text: str) -> Digest:
        data = np.frombuffer(text.encode(), np.uint8).astype(np.uint32)
        counts = np.zeros(BUCKETS, np.int64)
        if len(data) > 3:
            for j, k, odd in TRIPLETS:
                h = (data[3:] << np.uint32(16)) | (data[3 - j : -j] << np.uint32(8)) | data[3 - k : -k]
                h = (h + np.uint32(j + 4 * k)) * np.uint32(odd)
                counts += np.bincount((h >> np.uint32(24)).astype(np.int64), minlength=BUCKETS)
        q = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
        codes = (counts > q[0]).astype(np.uint8) + (counts > q[1]) + (counts > q[2])
        top = max(int(q[2]), 1)
        size = int(np.log1p(len(data)) * 8)
        return cls(size, (int(q[0]) * 15 // top, int(q[1]) * 15 // top), codes)

    @classmethod
    def parse(cls, text: str) -> Digest:
        data = np.frombuffer(bytes.fromhex(text[4:]), np.uint8)
        codes = ((data[:, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3).ravel()
        return cls(int(text[:2], 16), (int(text[2], 16), int(text[3], 16)), codes)

    def __str__(self) -> str:
        four = self.codes.reshape(-1, 4)
        data = (four[:, 0] << 6) | (four[:, 1] << 4) | (four[:, 2] << 2) | four[:, 3]
        return f"{self.size:02x}{self.ratios[0]:x}{self.ratios[1]:x}{data.astype(np.uint8).tobytes().hex()}"

    def likeness(self, other: Digest) -> float:
        body = int(STEPS[np.abs(self.codes.astype(np.int8) - other.codes.astype(np.int8))].sum())
        head = min(4 * abs(self.size - other.size), 100)
        head += sum(min(4 * abs(a - b), 24) for a, b in zip(self.ratios, other.ratios))
        return 1.0 - min(body + head, MOST) / MOST


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints, from 0 to 1; equal fingerprints have 1."""
    return Digest.parse(a).likeness(Digest.parse(b))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, fingerprint`` of every row; a null text reads as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                texts = piece.column("text").to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([str(Digest.of(t)) for t in texts])],
                    ["doc_id", "n_chars", "fingerprint"],
                )

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return base.mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def with_ranges(docs: DataFrame) -> DataFrame:
    """Rows of ``docs(doc_id, text)`` dealt out by ranges of the id, with ``part`` and ``extra``.

    The row that follows a range in descending order, the head of the next lower range, is
    dealt to that range too, with ``extra`` set; after the lowest range the highest follows.
    """
    rows = docs.count()
    ranges = max(1, min(MOST_RANGES, rows // RANGE_ROWS))
    cuts = []
    if ranges > 1:
        at = [i / ranges for i in range(1, ranges)]
        cuts = docs.agg(F.percentile_approx("doc_id", at, 10 * MOST_RANGES)).first()[0] or []
    edges = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:  # null ids come last in descending order: range 0
        known = ids.notna()
        out = np.zeros(len(ids), np.int32)
        out[known] = np.searchsorted(edges, ids[known].astype("int64"), side="left")
        return pd.Series(out)

    placed = docs.withColumn("part", part_of("doc_id"))
    heads = placed.select("doc_id", "part").groupBy("part").agg(F.max("doc_id").alias("head")).orderBy("part").collect()  # one row per range
    spark = docs.sparkSession
    above = [heads[(i + 1) % len(heads)]["part"] for i in range(len(heads))]
    table = spark.createDataFrame([(h["head"], part) for h, part in zip(heads, above)], "head long, above int")
    table = F.broadcast(table)  # at most MOST_RANGES rows
    both = placed.join(table, placed["doc_id"].eqNullSafe(table["head"]), "left")
    home = F.struct(F.col("part"), F.lit(False).alias("extra"))
    away = F.struct(F.col("above").alias("part"), F.lit(True).alias("extra"))
    copies = F.explode(F.when(F.col("above").isNull(), F.array(home)).otherwise(F.array(home, away))).alias("to")
    return both.select("doc_id", "text", copies).select("doc_id", "text", "to.part", "to.extra")


REPORT = (
    "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
REPORT_NAMES = [c.split()[0] for c in REPORT.split(", ")]


def edit_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness to each other.

    The edited text has its last ``n_chars // 3`` code points replaced by the first as many
    (or all) of the next document in descending doc_id; after the last comes the first. Ids
    that repeat are taken in the order of a hash of their texts, null ids at the end. Only
    one pass moves the texts, by ranges of the id; a range is read in order, row by row.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    dealt = with_ranges(base).withColumn("tie", text_key())
    dealt = dealt.repartition("part").sortWithinPartitions("part", "extra", F.col("doc_id").desc_nulls_last(), "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            for piece in pieces(batch, "text"):
                out = []
                for row in zip(*(piece.column(c).to_pylist() for c in ("part", "extra", "doc_id", "text"))):
                    part, extra, doc_id, text = row
                    if before is None and extra:
                        continue  # a head whose id repeats: only the first follows the range
                    digest = Digest.of(text)
                    if before is not None:
                        own_id, own, own_digest = before
                        k = len(own) // 3
                        edited = own[: len(own) - k] + text[:k]
                        edited_digest = Digest.of(edited)
                        out.append((
                            own_id, len(own), edited, str(own_digest), str(edited_digest),
                            own_digest.likeness(edited_digest), own_digest.likeness(digest),
                        ))
                    before = None if extra else (doc_id, text, digest)
                schema = pa.schema([(n, t) for n, t in zip(REPORT_NAMES, [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2])])
                columns = list(zip(*out)) or [[]] * len(REPORT_NAMES)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    return dealt.select("part", "extra", "doc_id", "text").mapInArrow(run, REPORT)


def digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows that the registered query returns."""
    return edit_report(docs.select("doc_id", "text")).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        "near_edited", "near_next",
    )
