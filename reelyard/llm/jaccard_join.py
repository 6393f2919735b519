"""Near-duplicate documents by a grouped prefix join on word shingles.

Two sets of sizes ``n`` with ``100 * |A & B| >= 90 * |A | B|`` share a shingle among the first
``n - ceil(0.9 n) + 1`` of each, in any order of shingles that holds for all documents. The
order used is by the number of documents that hold a shingle, then by hash. Shingles of one
document only come first, and need no place in the index, since nothing shares them.

1. Documents with equal sets are one *class*; classes with the same prefix and size are one
   *group*, which enters the index once.
2. The index lists the groups of each prefix shingle. Every group is first compared with one
   leader of each of its lists; the links found join classes into clusters.
3. Lists that still hold several clusters are expanded into the pairs of groups of different
   clusters, then to their member classes. So a family of thousands of copies costs a star of
   comparisons, and no link between clusters is missed.
4. Pairs pass filters by size, by the place of the shared shingle and by parity (the Hamming
   distance of two parity sketches never exceeds the size of the symmetric difference) and are
   verified on the whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import BUCKET_WORDS, Block, from_planes, make_blocks, pack_sorted, planes, range_slices, unpack_sorted, word_total
from .components import components
from .tables import on_row, packed, stored, text_key, text_of, unpacked
from .texts import U, Words, distinct_in_rows, pieces, signed

SHINGLE = 3
#: Similarity as a fraction of whole numbers.
SIMILARITY = (90, 100)
SKETCH_BITS = 512
#: Counts of documents are told apart up to here; the order stays one for all documents.
MOST_COUNT = 255

PROFILE = (
    "doc_id long, text_key long, n int, class_key binary, group_key binary, "
    "prefix array<long>, places array<int>, sketch array<long>"
)


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    return distinct_in_rows(*Words(texts).grams(size))


class ShingleBlock(Block):
    """The shingle sets of a block's documents, and their distinct count keys in order.

    A count key is the leading ``bits`` of a shingle hash. Keys are dealt out to buckets by
    range, so a bucket's keys lie side by side.
    """

    def __init__(self, row: dict, size: int, bits: int):
        super().__init__(row)
        self.sets = distinct_in_rows(*self.grams(size))
        keys = np.concatenate([*self.sets, np.zeros(0, U)]) >> U(64 - bits)
        self.keys, self.at, self.counts = np.unique(keys, return_inverse=True, return_counts=True)


KEYS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
COUNTS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("held", pa.binary())])
PROFILES = pa.schema([
    ("doc_id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int32()), ("class_key", pa.binary()),
    ("group_key", pa.binary()), ("prefix", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())), ("sketch", pa.list_(pa.int64())),
])


def count_documents(table: pa.Table) -> pa.Table:
    """Documents that hold each key of a bucket, for every block's keys."""
    parts = [unpack_sorted(x) for x in table["keys"].to_pylist()]
    counts = np.concatenate([from_planes(x, np.uint32) for x in table["counts"].to_pylist()])
    keys, at = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.minimum(np.bincount(at, weights=counts, minlength=len(keys)), MOST_COUNT).astype(np.uint8)[at]
    cuts = np.cumsum([len(p) for p in parts])[:-1]
    held = pa.array([x.tobytes() for x in np.split(total, cuts)], pa.binary())
    return pa.Table.from_arrays([table["block"], table["bucket"], held], schema=COUNTS)


def profile_block(row: dict, counted: list[dict], size: int, bits: int, similarity: tuple[int, int]) -> pa.Table:
    """Set size, class, group, shared prefix shingles with their places, and parity sketch of a
    block's documents."""
    num, den = similarity
    block = ShingleBlock(row, size, bits)
    order = sorted(counted, key=lambda r: r["bucket"])
    held = np.frombuffer(b"".join(r["held"] for r in order), np.uint8)[block.at]
    cuts = np.cumsum([len(s) for s in block.sets])[:-1]
    out = {name: [] for name in PROFILES.names}
    for s, h in zip(block.sets, np.split(held, cuts)):
        keep = len(s) + num * len(s) // -den + 1 if len(s) else 0
        rare = np.argsort(h, kind="stable")[:keep]
        odd = np.bincount((s & U(SKETCH_BITS - 1)).view(np.int64), minlength=SKETCH_BITS) & 1
        out["n"].append(len(s))
        out["class_key"].append(blake2b(s.tobytes(), digest_size=16).digest())
        out["group_key"].append(blake2b(s[rare].tobytes() + len(s).to_bytes(8, "big"), digest_size=16).digest())
        shared = np.flatnonzero(h[rare] > 1)
        out["prefix"].append(signed(s[rare[shared]]))
        out["places"].append(shared.astype(np.int32))
        out["sketch"].append(np.packbits(odd.astype(bool)).view(np.int64))
    out["doc_id"], out["text_key"] = row["doc_id"], row["text_key"]
    return pa.Table.from_pydict(out, schema=PROFILES)


def profiles(docs: DataFrame, size: int, similarity: tuple[int, int]) -> DataFrame:
    """The profile of every document, in the order of shingles of the whole corpus."""
    blocks = stored(make_blocks(docs, ["doc_id", "text_key"]), "shingle-blocks")
    words = word_total(blocks)
    buckets = int(words // BUCKET_WORDS) + 1
    bits = min(64, max(32, words.bit_length() + 10))  # few shingles share a count

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block = ShingleBlock(row, size, bits)
                rows = [
                    {"block": row["block"], "bucket": b, "keys": pack_sorted(block.keys[at]), "counts": planes(block.counts[at].astype(np.uint32))}
                    for b, at in range_slices(block.keys, buckets, bits)
                ]
                yield pa.RecordBatch.from_pylist(rows, schema=KEYS)

    def profile(left: pa.Table, right: pa.Table) -> pa.Table:
        return profile_block(left.to_pylist()[0], right.to_pylist(), size, bits, similarity)

    keys = blocks.mapInArrow(explode, "block long, bucket int, keys binary, counts binary")
    counted = keys.groupBy("bucket").applyInArrow(count_documents, "block long, bucket int, held binary")
    return blocks.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(profile, PROFILE)


def similar_sizes(a: Column, b: Column, similarity: tuple[int, int]) -> Column:
    num, den = similarity
    return (F.least(a, b) * den >= F.greatest(a, b) * num)


def could_link(pairs: DataFrame, classes: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Pairs ``(a, b)`` of class numbers that sizes and parity sketches don't rule out.

    With sizes m, n and similarity p / q the symmetric difference is at most
    ``(m + n) (q - p) / (q + p)``.
    """
    num, den = similarity
    side = classes.select("c", "n", "sketch")
    left = side.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = side.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    apart = F.aggregate(
        F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y
    )
    ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()
    return (
        ordered.join(left, "a").join(right, "b")
        .where(similar_sizes(F.col("na"), F.col("nb"), similarity))
        .where(apart * (den + num) <= (F.col("na") + F.col("nb")) * (den - num))
        .select("a", "b")
    )


def verified(
    pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, similarity: tuple[int, int]
) -> DataFrame:
    """The pairs of classes that are linked, judged on the whole texts of one row of each."""
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        num, den = similarity
        for batch in batches:
            for piece in pieces(batch, "ta"):
                for part in pieces(piece, "tb"):
                    ok = []
                    for x, y in zip(shingle_sets(part.column("ta"), size), shingle_sets(part.column("tb"), size)):
                        both = np.concatenate([x, y])
                        both.sort()
                        common = int(np.count_nonzero(both[1:] == both[:-1]))
                        ok.append(common > 0 and den * common >= num * (len(both) - common))
                    yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    pairs = stored(pairs, "shingle-pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    reps = classes.join(wanted, "c", "left_semi").select(
        "c", F.col("rep.doc_id").alias("doc_id"), F.col("rep.text_key").alias("text_key")
    )
    texts = stored(docs.join(reps, on_row(docs, reps)).select("c", docs["text"]), "class-texts")
    left = texts.select(F.col("c").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("c").alias("b"), F.col("text").alias("tb"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
    return rows.mapInArrow(judge, "a long, b long")


def near_duplicates(
    docs: DataFrame, size: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY
) -> DataFrame:
    """Component of every document: ``doc_id, text_key, n_shingles, component_id``.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; a text with fewer than
    ``size`` words has its whole sequence as its only shingle; a null text or one without
    words has no shingle and links with nothing. One row per input row. ``component_id`` is
    the smallest doc_id reachable by links; null ids are never the smallest, and a component
    of null ids only has a null component. Other columns are not read.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), text_of().alias("text"))
    rows = stored(profiles(base, size, similarity), "shingle-profiles")

    full = rows.where("n > 0")
    classes = full.groupBy("class_key").agg(
        F.min("doc_id").alias("first_id"), F.max(F.struct("doc_id", "text_key")).alias("rep"),
        F.first("n").alias("n"), F.first("group_key").alias("group_key"), F.first("sketch").alias("sketch"),
    )
    # numbers are fixed once the table is written
    classes = stored(classes.withColumn("c", F.monotonically_increasing_id()), "shingle-classes")
    # a group's number g is that of its smallest class
    groups = classes.groupBy("group_key").agg(
        F.min("c").alias("g"), F.count("*").alias("members"), F.first("sketch").alias("sketch")
    )
    heads = full.groupBy("group_key").agg(
        F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("places").alias("places")
    )
    groups = stored(groups.join(heads, "group_key"), "shingle-groups")
    member = classes.join(groups.select("group_key", "g"), "group_key").select("c", "g", "n")

    index = groups.select("g", "n", "members", F.inline(F.arrays_zip(F.col("prefix").alias("token"), F.col("places").alias("place"))))
    lists = index.groupBy("token").agg(F.sum("members").alias("held"), F.min("g").alias("leader")).where("held > 1")
    lists = stored(index.select("token", "g", "n", "place").join(lists.select("token", "leader"), "token"), "shingle-lists")

    stars = lists.select(F.col("g").alias("a"), F.col("leader").alias("b")).unionByName(
        member.select(F.col("c").alias("a"), F.col("g").alias("b"))
    )
    first = stored(verified(could_link(stars, classes, similarity), classes, base, size, similarity), "shingle-links")

    labels = components(first)
    placed = member.join(labels, F.col("c") == F.col("node"), "left").select(
        "c", "g", F.coalesce("label", "c").alias("cluster")
    )
    placed = stored(placed, "class-clusters")
    entries = lists.select("token", "g", "n", "place").join(placed.select("g", "cluster").distinct(), "g")
    mixed = entries.groupBy("token").agg(F.min("cluster").alias("x"), F.max("cluster").alias("y")).where("x != y")
    entries = entries.join(mixed.select("token"), "token", "left_semi")
    # a group of one class has its sketch; what several classes share is tested class by class
    alone = F.when(F.col("members") == 1, F.col("sketch"))
    words = SKETCH_BITS // 64
    entries = stored(
        entries.join(groups.select("g", *[F.get(alone, F.lit(i)).alias(f"s{i}") for i in range(words)]), "g"), "mixed-lists"
    )

    def side(x: str) -> DataFrame:
        renamed = {"g": f"g{x}", "n": f"n{x}", "cluster": f"k{x}", "place": f"i{x}"}
        return entries.select(
            "token", *[F.col(old).alias(new) for old, new in renamed.items()], *[F.col(f"s{i}").alias(f"s{i}{x}") for i in range(words)]
        )

    num, den = similarity
    both = F.col("na") + F.col("nb")
    apart = sum((F.bit_count(F.col(f"s{i}a").bitwiseXOR(F.col(f"s{i}b"))) for i in range(words)), F.lit(0))
    # At the first shingle that two sets share, at places i and j, at most the rest of either
    # set is shared. A linked pair passes at that shingle; elsewhere it need not.
    across = (
        side("a").join(side("b"), "token").where("ka < kb")
        .where(similar_sizes(F.col("na"), F.col("nb"), similarity))
        .where(F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) * (num + den) >= both * num)
        .where(F.coalesce(apart * (den + num) <= both * (den - num), F.lit(True)))
        .select("ga", "ka", "gb", "kb").distinct()
    )
    ends = placed.select("c", "g", "cluster")
    pairs = across.join(
        ends.select(F.col("c").alias("a"), F.col("g").alias("ga"), F.col("cluster").alias("ka")), ["ga", "ka"]
    ).join(
        ends.select(F.col("c").alias("b"), F.col("g").alias("gb"), F.col("cluster").alias("kb")), ["gb", "kb"]
    )
    second = verified(could_link(pairs.select("a", "b"), classes, similarity), classes, base, size, similarity)
    labels = components(first.unionByName(second))

    smallest = labels.join(classes.select(F.col("c").alias("node"), "first_id"), "node")
    smallest = smallest.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of_class = labels.join(smallest, "label").select(F.col("node").alias("c"), "component_id")
    of_class = classes.select("class_key", "c", "first_id").join(of_class, "c", "left").select(
        "class_key", F.coalesce("component_id", "first_id").alias("component_id")
    )
    out = rows.select("doc_id", "text_key", "n", "class_key").join(of_class, "class_key", "left")
    return out.select(
        "doc_id", "text_key", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def one_per_group(docs: DataFrame, size: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each component: the one whose id is the component's.

    Documents without shingles and those of components of null ids only all stay. Rows that
    repeat id and text of a kept row go. All columns of ``docs`` are kept.
    """
    found = near_duplicates(docs, size, similarity)
    kept = found.where(F.col("component_id").eqNullSafe(F.col("doc_id"))).select(
        F.struct("doc_id", "text_key").alias("_row")
    ).distinct()
    own = F.struct(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"))
    keyed = packed(docs, own.alias("_row")).join(kept, "_row", "left_semi").dropDuplicates(["_row"])
    return keyed.select(*unpacked(docs.columns))


def digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows that the registered query returns."""
    return near_duplicates(docs.select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")
