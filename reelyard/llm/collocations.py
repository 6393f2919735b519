"""Phrase collocations per language, counted by a trie of burstable containers.

Texts become *blocks* of word numbers. Phrases are counted in rounds, from two words upwards: a
phrase of ``k`` words is counted only where both its parts of ``k - 1`` words are frequent, so
what a round moves shrinks. A frequent word or phrase gets a number of its own; a phrase is
then exactly one 64-bit key, the number of its first ``k - 1`` words and that of its last word.

A block counts its keys in a HAT trie: a shallow trie over the digits of the key (first the
leading words, then the last) with containers at its leaves that burst into nodes when they
grow too large. When the trie holds too much, its largest subtree is spilled as a sorted run. Runs are cut
by prefix (leading words and the first digit of the last one, so that a frequent prefix is
dealt to many partitions) and merged there; the totals go back to the blocks as numbers of
the phrases that are frequent.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import from_planes, pack_sorted, planes, unpack_sorted
from ..session import forget
from .tables import stored, text_of
from .texts import _LOWER, U, flat, mix, pieces

LONGEST = 5
LEAST = 100
TOP = 2000
#: Bytes of text in a block, about.
BLOCK_BYTES = 4 << 20
#: Frequent words are broadcast to where the blocks' words are looked up if they take no more bytes.
BROADCAST_BYTES = 16 << 20
#: Keys that a merging task gets, on average.
MERGE_KEYS = 1_000_000
#: Distinct keys of a container before it bursts, and keys of a trie before it spills.
CONTAINER_KEYS = 1 << 15
TRIE_KEYS = 1 << 21
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Bits of a trie digit.
DIGIT = 6
#: A prefix is dealt to up to ``2 ** SPREAD`` partitions, by the first digit of its last word.
SPREAD = 6

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?"] + list(range(0x0A, 0x0E))] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True


def piece_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of texts, which text each is of, and whether a break comes before it."""
    data, offsets = flat(texts)
    if not len(data):
        return pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, bool)
    inside = ~_GAP[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(inside & (~np.concatenate([[False], inside[:-1]]) | edge[:-1]))
    end = np.flatnonzero(inside & (~np.concatenate([inside[1:], [False]]) | edge[1:])) + 1
    at = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(
        len(start), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(_LOWER[data[inside]]))
    )
    breaks = np.concatenate([[0], np.cumsum(_BREAK[data])])[start]
    doc = np.searchsorted(offsets, start, side="right") - 1
    first = np.ones(len(start), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (breaks[1:] != breaks[:-1])
    return words, doc, first


def squeeze(data: bytes) -> bytes:
    """Packed bytes: their size and their zstd form, since word numbers are far from uniform."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def loosen(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def pack(x: np.ndarray) -> bytes:
    """Numbers in as many bytes as the largest needs, four or eight, said by the first byte."""
    kind = np.uint64 if x.max(initial=0) >> U(32) else np.uint32
    return bytes([kind().itemsize]) + squeeze(planes(np.ascontiguousarray(x.astype(kind))))


def unpack(data: bytes) -> np.ndarray:
    return from_planes(loosen(data[1:]), f"u{data[0]}").astype(U)


@contextmanager
def few_rows(spark: SparkSession, rows: int = 2) -> Iterator[None]:
    """Arrow batches of a few rows, for tables whose rows are whole blocks."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


class HatTrie:
    """Counts of 64-bit keys below ``2 ** bits``, in the order of the keys.

    Inner nodes branch by the next digit of the key; only the way down to crowded containers
    is ever built. A container takes batches of keys as they come and merges them when it is
    full; if it then still holds more than ``container`` distinct keys, it bursts into a node.
    Beyond ``most`` keys in all, the largest subtree below the root leaves as a sorted run.
    """

    def __init__(self, bits: int, container: int = CONTAINER_KEYS, most: int = TRIE_KEYS):
        self.shift = max(0, bits - DIGIT)
        self.container, self.most = container, most
        self.root: dict[int, dict] = {}
        self.held = 0
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []

    @staticmethod
    def _leaf() -> dict:
        return {"batches": [], "size": 0}

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Add sorted distinct keys with their counts."""
        self._spread(self.root, keys, counts, self.shift)
        while self.held > self.most:
            self._spill(max(self.root, key=lambda d: self._size(self.root[d])))

    def _spread(self, node: dict, keys: np.ndarray, counts: np.ndarray, shift: int) -> None:
        digits = (keys >> U(shift)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(digits)) + 1
        for k, c in zip(np.split(keys, cuts), np.split(counts, cuts)):
            if len(k):
                digit = int(k[0] >> U(shift))
                child = node.setdefault(digit, self._leaf())
                self._insert(node, digit, child, k, c, shift)

    def _insert(self, node: dict, digit: int, child: dict, keys: np.ndarray, counts: np.ndarray, shift: int) -> None:
        if "batches" not in child:
            self._spread(child["node"], keys, counts, max(0, shift - DIGIT))
            return
        child["batches"].append((keys, counts))
        child["size"] += len(keys)
        self.held += len(keys)
        if child["size"] > self.container:
            keys, counts = merged(child["batches"])
            self.held -= child["size"] - len(keys)
            child["batches"], child["size"] = [(keys, counts)], len(keys)
            if child["size"] > self.container and shift:
                self.held -= child["size"]
                node[digit] = {"node": {}}
                self._spread(node[digit]["node"], keys, counts, max(0, shift - DIGIT))

    def _size(self, child: dict) -> int:
        return child["size"] if "batches" in child else sum(map(self._size, child["node"].values()))

    def _parts(self, child: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if "batches" in child:
            if child["size"]:
                yield merged(child["batches"])
        else:
            for digit in sorted(child["node"]):
                yield from self._parts(child["node"][digit])

    def _spill(self, digit: int) -> None:
        child = self.root.pop(digit)
        self.held -= self._size(child)
        parts = list(self._parts(child))
        if parts:
            self.runs.append((np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])))

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct keys of all runs and of what is left, with their counts."""
        for digit in sorted(self.root):
            self._spill(digit)
        runs, self.runs = self.runs, []
        return merged(runs)


def merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of sorted runs and the sums of their counts."""
    if not runs:
        return np.zeros(0, U), np.zeros(0, np.int64)
    if len(runs) == 1:
        return runs[0]
    keys = np.concatenate([r[0] for r in runs])
    order = np.argsort(keys, kind="stable")  # merges the runs, which are sorted
    keys, counts = keys[order], np.concatenate([r[1] for r in runs])[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


BLOCK = "block long, langs array<string>, totals array<long>, words array<string>, lang array<int>, n array<long>, stream binary"


def word_blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Blocks of ``docs(text, lang)``: their distinct words by language, and all words in order.

    ``stream`` numbers the words of the block from 1, with a 0 before every piece. Store the
    result before its block numbers are used: they depend on the partitioning.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block() -> pa.RecordBatch:
            words = pa.chunked_array([h[0] for h in held]).combine_chunks().dictionary_encode()
            langs = pa.chunked_array([h[1] for h in held]).combine_chunks().dictionary_encode()
            word, lang = (np.asarray(x.indices).astype(np.int64) for x in (words, langs))
            first = np.concatenate([h[2] for h in held])
            size = max(1, len(words.dictionary))
            pairs, at, n = np.unique(lang * size + word, return_inverse=True, return_counts=True)
            place = np.arange(len(at)) + np.cumsum(first)
            stream = np.zeros(len(at) + int(first.sum()), np.uint32)
            stream[place] = at + 1
            totals = np.bincount(lang, minlength=len(langs.dictionary))

            def one(values: pa.Array) -> pa.Array:
                return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

            return pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 32) + number]), one(langs.dictionary.cast(pa.string())), one(pa.array(totals, pa.int64())),
                    one(words.dictionary.cast(pa.string()).take(pa.array(pairs % size))), one(pa.array((pairs // size).astype(np.int32))),
                    one(pa.array(n, pa.int64())), pa.array([pack(stream.astype(U))], pa.binary()),
                ],
                ["block", "langs", "totals", "words", "lang", "n", "stream"],
            )

        for batch in batches:
            for piece in pieces(batch, "text"):
                words, doc, first = piece_words(piece.column("text"))
                if len(words):
                    langs = pc.take(piece.column("lang").cast(pa.large_string()), pa.array(doc))
                    held.append((words, langs, first))
                    size += words.nbytes
                if size >= block_bytes:
                    yield block()
                    number, held, size = number + 1, [], 0
        if held:
            yield block()

    return docs.select("text", "lang").mapInArrow(run, BLOCK)


def numbered(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with ``id``, its rows numbered from 1 without gaps; rows are distinct in ``keys``."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = stored(df.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")), "phrase-words")
    sizes = placed.groupBy("part").count()
    before = F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = sizes.select("part", F.coalesce(before, F.lit(0)).alias("base"))  # a row for each part
    own = F.row_number().over(Window.partitionBy("part").orderBy(*keys))
    return placed.withColumn("own", own).join(base, "part").select(*df.columns, (F.col("base") + F.col("own")).alias("id"))


STATE = "block long, words binary, grams binary, live long"


def translate(block: pa.Table, ids: pa.Table) -> pa.Table:
    """The stream of a block in numbers of frequent words; 0 is a break or any other word."""
    out = []
    for row in block.to_pylist():
        stream = unpack(row["stream"])
        known = np.zeros(int(stream.max(initial=0)) + 1, np.uint64)
        known[np.asarray(ids["place"]).astype(np.int64)] = np.asarray(ids["id"]).astype(np.uint64)
        out.append(state_of(row["block"], known[stream], known[stream], 1) | {"grams": None})  # they are the words
    return pa.Table.from_pylist(out, schema=STATE_SCHEMA)


STATE_SCHEMA = pa.schema([("block", pa.int64()), ("words", pa.binary()), ("grams", pa.binary()), ("live", pa.int64())])


def state_of(block: int, words: np.ndarray, grams: np.ndarray, size: int) -> dict:
    """State of a block after the round of ``size``: ``grams[i]`` numbers the phrase that begins at ``i``.

    Words that no longer phrase can reach are left out, one break in place of each stretch.
    """
    begins = np.zeros(len(grams), bool)
    begins[:-1] = (grams[:-1] > 0) & (grams[1:] > 0)
    keep = np.zeros(len(grams) + size + 1, bool)
    for k in range(size + 1):
        keep[k : k + len(begins)] |= begins
    keep = keep[: len(grams)]
    after = np.concatenate([[False], keep[:-1]])
    cut = after & ~keep  # the first word left out becomes the break
    words, grams = np.where(cut, U(0), words), np.where(cut, U(0), grams)
    # a phrase that ends beyond the break could not begin here: both its parts would be kept
    keep |= cut
    return {
        "block": block, "words": pack(words[keep]), "grams": pack(grams[keep]), "live": int(begins.sum()),
    }


RUNS = "block long, part int, keys binary, counts binary"
MERGED = "block long, part int, ids binary, keys array<long>, counts array<long>, found long"
MERGED_SCHEMA = pa.schema([
    ("block", pa.int64()), ("part", pa.int32()), ("ids", pa.binary()), ("keys", pa.list_(pa.int64())),
    ("counts", pa.list_(pa.int64())), ("found", pa.int64()),
])


def candidates(row: dict, size: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words and numbers of a block's state, where phrases of ``size`` words may begin, their keys."""
    words = unpack(row["words"])
    grams = words if row["grams"] is None else unpack(row["grams"])
    at = np.flatnonzero((grams[:-1] > 0) & (grams[1:] > 0))
    return words, grams, at, (grams[at] << U(bits)) | words[at + size - 1]


def parts_of(keys: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """Prefix partition of each key: by the number of its leading words and one digit of its last."""
    return (mix(keys >> U(max(0, bits - SPREAD))) % U(parts)).astype(np.int64)


def merge_part(table: pa.Table, least: int) -> pa.Table:
    """Totals of a prefix partition: the frequent keys, numbered from 1, and each block's answers."""
    runs = [unpack_sorted(loosen(x)) for x in table["keys"].to_pylist()]
    counts = [unpack(x).astype(np.int64) for x in table["counts"].to_pylist()]
    keys, totals = merged(list(zip(runs, counts)))
    often = totals >= least
    number = np.where(often, np.cumsum(often), 0)
    part, found = table["part"][0].as_py(), int(often.sum())
    rows = [{"block": None, "part": part, "ids": None, "keys": keys[often].view(np.int64), "counts": totals[often], "found": found}]
    for block, run in zip(table["block"].to_pylist(), runs):
        ids = number[np.searchsorted(keys, run)].astype(np.uint64)
        rows.append({"block": block, "part": part, "ids": pack(ids), "keys": None, "counts": None, "found": None})
    return pa.Table.from_pylist(rows, schema=MERGED_SCHEMA)


def grow(state: DataFrame, size: int, bits: int, least: int, merge_keys: int) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases of ``size`` words, ``id, head, last, f``, and the state of the blocks after them."""
    live = state.agg(F.sum("live")).first()[0] or 0
    parts = int(live // merge_keys) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                _, grams, _, keys = candidates(row, size, bits)
                if not len(keys):
                    continue
                trie = HatTrie(int(grams.max()).bit_length() + bits)
                for some in np.array_split(keys, len(keys) // 200_000 + 1):
                    trie.add(*np.unique(some, return_counts=True))
                keys, counts = trie.counts()
                part = parts_of(keys, bits, parts)
                order = np.argsort(part, kind="stable")  # keys of a part stay in order
                keys, counts, part = keys[order], counts[order], part[order]
                cuts = np.flatnonzero(np.diff(part)) + 1
                for p, k, c in zip(part[np.concatenate([[0], cuts])], np.split(keys, cuts), np.split(counts, cuts)):
                    yield pa.RecordBatch.from_pylist(
                        [{"block": row["block"], "part": int(p), "keys": squeeze(pack_sorted(k)), "counts": pack(c.astype(U))}],
                        schema=pa.schema([("block", pa.int64()), ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]),
                    )

    def answer(block: pa.Table, ids: pa.Table) -> pa.Table:
        parts_found = {r["part"]: (r["base"], unpack(r["ids"])) for r in ids.to_pylist()}
        out = []
        for row in block.to_pylist():
            words, grams, at, keys = candidates(row, size, bits)
            distinct, place = np.unique(keys, return_inverse=True)
            part = parts_of(distinct, bits, parts)
            number = np.zeros(len(distinct), np.uint64)
            for p, (base, own) in parts_found.items():
                number[part == p] = np.where(own > 0, own + U(base), U(0))
            longer = np.zeros(len(grams), np.uint64)
            longer[at] = number[place]
            out.append(state_of(row["block"], words, longer, size))
        return pa.Table.from_pylist(out, schema=STATE_SCHEMA)

    runs = state.where("live > 0").select("block", "words", "grams").mapInArrow(count, RUNS)
    with few_rows(state.sparkSession):
        merges = stored(runs.groupBy("part").applyInArrow(lambda t: merge_part(t, least), MERGED), "phrase-merges")
    found = merges.where("found is not null").select("part", "keys", "counts", "found")
    before = F.sum("found").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = stored(found.select("part", F.coalesce(before, F.lit(0)).alias("base"), "found"), "phrase-bases")
    total = base.agg(F.sum("found")).first()[0] or 0
    if total.bit_length() + bits > 64:
        raise OverflowError(f"{total} frequent phrases of {size} words do not fit beside words of {bits} bits; raise least")
    listed = found.drop("found").join(base, "part").select("base", F.posexplode(F.arrays_zip("keys", "counts")).alias("own", "x"))
    phrases = listed.select(
        (F.col("base") + F.col("own") + 1).alias("id"), F.shiftrightunsigned("x.keys", bits).alias("head"),
        F.col("x.keys").bitwiseAND((1 << bits) - 1).alias("last"), F.col("x.counts").alias("f"),
    )
    answers = merges.where("found is null").select("block", "part", "ids").join(base.select("part", "base"), "part")
    after = state.where("live > 0").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(answer, STATE)
    with few_rows(state.sparkSession):
        after = stored(after, "phrase-state")
    phrases = stored(phrases, "phrases")
    forget(state, merges, base)
    return phrases, after


def frequent_phrases(
    docs: DataFrame, longest: int = LONGEST, least: int = LEAST, block_bytes: int = BLOCK_BYTES, merge_keys: int = MERGE_KEYS
) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, size, f`` of all phrases of up to ``longest`` words found ``least`` times, and ``lang, n``."""
    base = docs.select(text_of().alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    blocks = stored(word_blocks(base, block_bytes), "phrase-blocks")
    totals = blocks.select(F.explode(F.arrays_zip("langs", "totals")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(
        F.sum("x.totals").alias("n")
    )
    totals = stored(totals, "phrase-totals")
    places = blocks.select("block", "langs", F.posexplode(F.arrays_zip("words", "lang", "n")).alias("pos", "x")).select(
        "block", (F.col("pos") + 1).alias("place"), F.col("langs")[F.col("x.lang")].alias("lang"), F.col("x.words").alias("phrase"),
        F.col("x.n").alias("n"),
    )
    words = places.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    words = stored(numbered(words, ["lang", "phrase"]), "phrase-words")
    most, size = words.agg(F.max("id"), F.sum(F.octet_length("phrase") + F.octet_length("lang") + 16)).first()
    bits = max(SPREAD, (most or 0).bit_length())
    lookup = words.drop("f")
    lookup = F.broadcast(lookup) if (size or 0) <= BROADCAST_BYTES else lookup
    ids = places.drop("n").join(lookup, ["lang", "phrase"]).select(F.col("block").alias("owner"), "place", "id")
    words_in = blocks.select("block", "stream")
    state = stored(
        words_in.groupBy("block").cogroup(ids.groupBy("owner")).applyInArrow(translate, STATE), "phrase-state"
    )
    forget(blocks)
    found = [words.select("lang", "phrase", F.lit(1).alias("size"), "f", "id")]
    ends = words.select(F.col("id").alias("last"), F.col("phrase").alias("word"))
    for size in range(2, longest + 1):
        phrases, state = grow(state, size, bits, least, merge_keys)
        heads = found[-1].select("lang", F.col("phrase").alias("start"), F.col("id").alias("head"))
        named = phrases.join(ends, "last").join(heads, "head")
        found.append(stored(named.select("lang", F.concat_ws(" ", "start", "word").alias("phrase"), F.lit(size).alias("size"), "f", "id"), "phrases"))
        forget(phrases)
    forget(state)
    return reduce(DataFrame.unionByName, found).drop("id"), totals


def collocations(
    docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int | None = TOP, inside: int = 100,
    block_bytes: int = BLOCK_BYTES, merge_keys: int = MERGE_KEYS,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the ``top`` phrases of every language (None: all).

    Texts are lower-cased (A-Z), cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these into words
    ``[^\\x20\\x09]+``; a null or empty text has none, a null language is ``und``, a repeated row
    counts twice, an empty table gives no rows; other columns are not read. A phrase of 2 to
    ``longest`` words with ``a >= least`` occurrences within pieces, cut into ``l`` and ``r``
    occurrences of its parts, scores ``floor(1000 * a * n / (l * r))``, ``n`` being all words
    of its language; the cut of the lowest score counts, of several the first. A phrase goes if
    a longer one holds it with ``100 * f >= inside * a``. Order: score and ``a`` descending, phrase.
    """
    phrases, totals = frequent_phrases(docs, longest, least, block_bytes, merge_keys)
    phrases = stored(phrases, "phrases")
    long = phrases.where("size > 1")
    part = long.select(
        "lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    ).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")), " ").alias("rest"),
    )
    known = phrases.select("lang", "phrase", "f")
    part = part.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    part = part.join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    part = part.join(totals, "lang")
    wide = {c: F.col(c).cast("decimal(17,0)") for c in ("a", "n", "l", "r")}
    above, below = wide["a"] * wide["n"] * F.lit(1000).cast("decimal(4,0)"), wide["l"] * wide["r"]
    part = part.withColumns({"above": above, "below": below}).withColumn("score", F.expr("above div below"))
    cut = part.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    cut = cut.select("lang", "phrase", "a", "n", "cut.score", "cut.l", "cut.r")
    spots = F.expr(
        "flatten(transform(sequence(1, size), i -> transform(sequence(2, size), m ->"
        " if(i + m <= size + 1 and m < size, array_join(slice(words, i, m), ' '), null))))"
    )
    held = long.where("size > 2").select("lang", "f", "size", F.split("phrase", " ").alias("words")).select(
        "lang", "f", F.explode(spots).alias("phrase")
    ).where("phrase is not null").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    left = cut.join(held, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * inside)
    )
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows that the registered query returns."""
    return collocations(docs.select("text", "lang"))
