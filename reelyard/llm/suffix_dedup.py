"""Removal of byte strings of a given length that occur more than once, by suffix arrays.

A window is any run of ``length`` bytes of a document. Its *anchor* is the smallest hash of
the ``ANCHOR`` -byte strings in it, so equal windows have equal anchors. The window starts of
a document fall into stretches with the same anchor; the bytes that the windows of a stretch
cover are its *context*. Only windows of stretches with the same anchor can be equal:

1. Stretches are counted by anchor and context. Where an anchor has one context that occurs
   twice, all its windows are repeated; where it occurs once, none is.
2. The other anchors' distinct contexts are dealt out to shards. A shard sorts all suffixes
   of its contexts (Larsson-Sadakane refinement), computes common prefixes (Kasai's relation
   between neighbouring suffixes) and so finds the classes of equal windows.
3. An anchor with many contexts is dealt to several shards. Each hands on its classes as
   sorted arrays, cut by value, and each cut is merged by binary search across the shards.

Contexts that occur in many documents travel once, with a count. Nothing is left out: a
stretch is skipped only if no other stretch of any document has its anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import on_row, stored, text_key, text_of
from .texts import U, RollingHash, flat, mix, pieces, signed

LENGTH = 400
ANCHOR = 128
#: Bytes of contexts that a shard holds on average.
SHARD_BYTES = 1 << 20
#: Contexts of one anchor in a shard; an anchor with more is dealt to several.
SHARD_CONTEXTS = 512

STRETCH = "doc_id long, text_key long, start int, stop int, anchor long, context long, again boolean"
FOUND = "anchor long, context long, cut int, runs array<int>, hashes array<long>, owners array<long>, offsets array<int>"


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """Extreme of every ``width`` neighbours, by doubling."""
    step = 1
    while step * 2 <= width:
        x = pick(x[:-step], x[step:])
        step *= 2
    return pick(x[: len(x) - (width - step)], x[width - step :]) if step < width else x


def stretches(h: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last window start, anchor value and "anchor occurs again" of each stretch.

    ``h`` are the hashes of all ``anchor`` -byte strings of one document of ``length`` bytes
    or more.
    """
    width = length - anchor + 1
    low = sliding(h, width, np.minimum)
    start = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    stop = np.concatenate([start[1:], [len(low)]]) - 1
    pad = np.zeros(width - 1, U)
    chosen = np.flatnonzero(sliding(np.concatenate([pad, low, pad]), width, np.maximum) == h)
    again = np.zeros(len(start), bool)
    if len(chosen) > len(start) or (h[chosen[1:]] == h[chosen[:-1]]).any():
        for i, (a, b) in enumerate(zip(start, stop)):
            again[i] = np.count_nonzero(h[a : b + width] == low[a]) > 1
    return start, stop, low[start], again


def find_stretches(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                data, offsets = flat(piece.column("text"))
                long = np.flatnonzero(np.diff(offsets) >= length)
                if not len(long):
                    continue
                rolling = RollingHash(data)
                h = rolling.windows(anchor)
                parts = []
                for i in long:
                    a, b = offsets[i], offsets[i + 1]
                    start, stop, low, again = stretches(h[a : b - anchor + 1], length, anchor)
                    context = rolling.of(start + a, stop + a + length)
                    parts.append((np.full(len(start), i), start, stop, low, context, again))
                row, start, stop, low, context, again = (np.concatenate(x) for x in zip(*parts))
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id").take(rows), piece.column("text_key").take(rows),
                        pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32)),
                        pa.array(signed(low)), pa.array(signed(context)), pa.array(again),
                    ],
                    ["doc_id", "text_key", "start", "stop", "anchor", "context", "again"],
                )

    return docs.mapInArrow(run, STRETCH)


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffixes of an array of small non-negative numbers, and the rank of each suffix.

    Suffixes are first sorted by seven symbols; groups that are still equal are then sorted by
    the rank of the suffix that begins where the compared part ends, which doubles that part.
    Suffixes that stand alone in their group are never touched again.
    """
    n = len(text)
    key = np.zeros(n, np.int64)
    padded = np.concatenate([text.astype(np.int64) + 1, np.zeros(7, np.int64)])
    for k in range(7):
        key = (key << 9) | padded[k : k + n]
    order = np.argsort(key, kind="stable")
    held = key[order]
    head = np.concatenate([[True], held[1:] != held[:-1]])
    first = np.flatnonzero(head)
    group = first[np.cumsum(head) - 1]
    rank = np.zeros(n + 1, np.int64)
    rank[order] = group + 1
    depth = 7
    sizes = np.diff(np.concatenate([first, [n]]))
    active = np.flatnonzero(np.repeat(sizes > 1, sizes))
    while len(active):
        at = order[active]
        next_rank = rank[np.minimum(at + depth, n)]
        own = rank[at]
        sort = np.argsort(own * (n + 1) + next_rank, kind="stable")
        at, own, next_rank = at[sort], own[sort], next_rank[sort]
        order[active] = at
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (next_rank[1:] != next_rank[:-1])])
        first = np.flatnonzero(new)
        rank[at] = active[first][np.cumsum(new) - 1] + 1
        sizes = np.diff(np.concatenate([first, [len(at)]]))
        active = active[np.repeat(sizes > 1, sizes)]
        depth *= 2
    return order, rank[:n] - 1


def common_prefixes(text: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each sorted suffix with the one before it.

    Kasai's relation: the prefix that a suffix shares with its predecessor is one symbol
    shorter than that of the suffix one place to the left, if both are preceded by the same
    symbol. Only the other places are compared, all at once and word by word.
    """
    n = len(text)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    place = np.arange(n)
    same = np.zeros(n, bool)
    same[1:] = (before[1:] > 0) & (before[:-1] >= 0) & (text[:-1] == text[np.maximum(before[1:] - 1, 0)])
    # the relation holds for the predecessor one place to the left of this one
    same[1:] &= before[:-1] == before[1:] - 1
    fresh = np.flatnonzero(~same)
    words = np.zeros(n + 8, np.int64)
    padded = np.concatenate([text.astype(np.int64) + 1, np.zeros(16, np.int64)])
    for k in range(7):
        words = (words << 9) | padded[k : k + n + 8]
    size = np.zeros(len(fresh), np.int64)
    live = np.flatnonzero(before[fresh] >= 0)
    while len(live):
        differ = words[fresh[live] + size[live]] ^ words[before[fresh[live]] + size[live]]
        equal = differ == 0
        lead = sum((differ >> (9 * k) == 0).astype(np.int64) for k in range(1, 7))
        size[live] += np.where(equal, 7, lead)
        live = live[equal]
    value = np.zeros(n, np.int64)
    value[fresh] = size + fresh
    origin = np.maximum.accumulate(np.where(same, -1, place))
    left = value[origin] - place
    return left[order]


def equal_windows(contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, offset and class of every window of ``length`` bytes of a shard."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    text = np.zeros(int(sizes.sum()) + len(contexts), np.int16)
    starts = np.cumsum(sizes + 1) - sizes - 1
    owner = np.repeat(np.arange(len(contexts)), sizes + 1)
    inner = np.ones(len(text), bool)
    inner[starts + sizes] = False
    text[inner] = np.frombuffer(b"".join(contexts), np.uint8).astype(np.int16) + 1  # 0 ends a context
    order, rank = suffix_array(text)
    shared = common_prefixes(text, order, rank)
    label = np.cumsum(shared < length)
    whole = starts[owner[order]] + sizes[owner[order]] - order >= length
    at = order[whole]
    return owner[at], at - starts[owner[at]], label[whole]


def runs_of(offsets: np.ndarray) -> list[int]:
    """First and last of each run of consecutive numbers, in one flat list."""
    offsets = np.unique(offsets)
    cut = np.flatnonzero(np.diff(offsets) != 1)
    first = offsets[np.concatenate([[0], cut + 1])]
    last = offsets[np.concatenate([cut, [len(offsets) - 1]])]
    return np.stack([first, last], 1).ravel().tolist()


def by_owner(owner: np.ndarray, offset: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    sort = np.argsort(owner, kind="stable")
    owner, offset = owner[sort], offset[sort]
    cut = np.flatnonzero(np.diff(owner)) + 1
    for o, part in zip(np.split(owner, cut), np.split(offset, cut)):
        if len(o):
            yield o[0], part


def shard_matches(table: pa.Table, length: int) -> pa.Table:
    """Repeated windows of one shard; classes of anchors that other shards share, to merge."""
    contexts = table["bytes"].to_pylist()
    anchor, context, n = (table[c].to_numpy() for c in ("anchor", "context", "n"))
    parts = table["parts"].to_numpy()
    owner, offset, label = equal_windows(contexts, length)
    total = np.bincount(label, weights=n[owner], minlength=1)
    twice = total[label] > 1
    out = [
        {"anchor": int(anchor[o]), "context": int(context[o]), "cut": -1, "runs": runs_of(part)}
        for o, part in by_owner(owner[twice], offset[twice])
    ]
    split = np.flatnonzero(parts[owner] > 1)
    if len(split):
        data = np.frombuffer(b"".join(contexts), np.uint8)
        base = np.concatenate([[0], np.cumsum([len(c) for c in contexts])])[:-1]
        at = base[owner[split]] + offset[split]
        hashes = mix(RollingHash(data, salt=1).of(at, at + length))
        cut = (hashes % parts[owner[split]].astype(U)).astype(np.int64)
        own = anchor[owner[split]]
        sort = np.lexsort([hashes, cut, own])
        split, hashes, cut, own = split[sort], hashes[sort], cut[sort], own[sort]
        edges = np.flatnonzero((np.diff(cut) != 0) | (np.diff(own) != 0)) + 1
        for rows, hs in zip(np.split(split, edges), np.split(hashes, edges)):
            o = owner[rows]
            out.append({
                "anchor": int(anchor[o[0]]), "context": None,
                "cut": int(hs[0] % U(parts[o[0]])), "hashes": signed(hs), "owners": context[o],
                "offsets": np.where(twice[rows], -1, offset[rows]).astype(np.int32),
            })
    return pa.Table.from_pylist(out, schema=FOUND_SCHEMA)


FOUND_SCHEMA = pa.schema([
    ("anchor", pa.int64()), ("context", pa.int64()), ("cut", pa.int32()), ("runs", pa.list_(pa.int32())),
    ("hashes", pa.list_(pa.int64())), ("owners", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int32())),
])


def merge_matches(table: pa.Table) -> pa.Table:
    """Windows of one cut of an anchor that occur in more than one shard.

    Every shard's sorted hashes are looked up in those of the others by binary search.
    Offsets of -1 mark windows that their own shard already found repeated.
    """
    hashes = [h.values.to_numpy() for h in table["hashes"]]
    owners = [o.values.to_numpy() for o in table["owners"]]
    offsets = [o.values.to_numpy() for o in table["offsets"]]
    seen = np.zeros(0, U)
    shared = np.zeros(0, U)
    for h in hashes:
        own = np.unique(h.view(U))
        at = np.minimum(np.searchsorted(seen, own), max(len(seen) - 1, 0))
        old = seen[at] == own if len(seen) else np.zeros(len(own), bool)
        shared = np.union1d(shared, own[old])
        seen = np.insert(seen, np.searchsorted(seen, own[~old]), own[~old])
    out = []
    for h, o, f in zip(hashes, owners, offsets):
        if not len(shared):
            break
        at = np.minimum(np.searchsorted(shared, h.view(U)), len(shared) - 1)
        hit = (shared[at] == h.view(U)) & (f >= 0)
        for context, part in by_owner(o[hit], f[hit]):
            out.append({"anchor": table["anchor"][0].as_py(), "context": int(context), "cut": -1, "runs": runs_of(part)})
    return pa.Table.from_pylist(out, schema=FOUND_SCHEMA)


def repeated_windows(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """Window starts that are repeated anywhere: ``doc_id, text_key, runs``.

    ``docs`` has ``doc_id``, ``text_key`` and ``text``. ``runs`` holds pairs of first and last
    start; one row per document that has any.
    """
    anchor = min(anchor, length)
    spots = stored(find_stretches(docs, length, anchor), "stretches")
    contexts = spots.groupBy("anchor", "context").agg(
        F.count("*").alias("n"), F.max("again").alias("again"), F.first("doc_id").alias("doc_id"),
        F.first("text_key").alias("text_key"), F.first("start").alias("start"), F.first("stop").alias("stop"),
    )
    heads = contexts.groupBy("anchor").agg(
        F.count("*").alias("kinds"), F.sum("n").alias("total"), F.max("again").alias("any_again")
    ).where("total > 1 or any_again")
    contexts = stored(contexts.join(heads, "anchor"), "contexts")
    plain = contexts.where("kinds = 1 and not any_again").select(
        "anchor", "context", F.array(F.lit(0), F.col("stop") - F.col("start")).alias("runs")
    )
    mixed = contexts.where("kinds > 1 or any_again")
    held = mixed.agg(F.sum(F.col("stop") - F.col("start") + length)).first()[0] or 0
    shards = int(held // SHARD_BYTES) + 1
    parts = F.ceil(F.col("kinds") / SHARD_CONTEXTS).cast("int")
    mixed = mixed.withColumn("parts", parts).withColumn(
        "shard",
        F.pmod(F.xxhash64("anchor", F.pmod(F.xxhash64("context"), F.col("parts"))), F.lit(shards)).cast("int"),
    )
    cuts = mixed.groupBy("doc_id", "text_key").agg(
        F.collect_list(F.struct("anchor", "context", "n", "parts", "shard", "start", "stop")).alias("cuts")
    )
    placed = docs.join(cuts, on_row(docs, cuts)).select(docs["doc_id"], docs["text_key"], "text", "cuts")
    # a row that repeats id and text would send its contexts twice
    placed = placed.dropDuplicates(["doc_id", "text_key"]).select("text", "cuts")

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                rows = []
                for text, cuts in zip(piece.column("text").to_pylist(), piece.column("cuts").to_pylist()):
                    data = text.encode()
                    rows += [{**c, "bytes": data[c["start"] : c["stop"] + length]} for c in cuts]
                yield pa.RecordBatch.from_pylist(rows, schema=SLICE_SCHEMA)

    sliced = placed.mapInArrow(slices, "anchor long, context long, n long, parts int, shard int, bytes binary")
    found = stored(
        sliced.groupBy("shard").applyInArrow(lambda t: shard_matches(t, length), FOUND), "shard-matches"
    )
    merged = found.where("cut >= 0").groupBy("anchor", "cut").applyInArrow(merge_matches, FOUND)
    marks = plain.unionByName(found.where("cut < 0").select("anchor", "context", "runs")).unionByName(
        merged.select("anchor", "context", "runs")
    )
    # several marks of a context come from its shard and from merged cuts: each is a row
    hits = spots.join(marks, ["anchor", "context"]).select(
        "doc_id", "text_key", F.transform("runs", lambda x: x + F.col("start")).alias("runs")
    )
    return hits.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("runs")).alias("runs"))


SLICE_SCHEMA = pa.schema([
    ("anchor", pa.int64()), ("context", pa.int64()), ("n", pa.int64()), ("parts", pa.int32()),
    ("shard", pa.int32()), ("bytes", pa.binary()),
])


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """Documents without the bytes that repeated strings of ``length`` bytes cover.

    Returns ``doc_id``, ``n_bytes``, ``kept`` (binary: a cut may fall inside a character) and
    ``spans``, the maximal removed runs as pairs of first byte and end, one row per input row.
    All copies of a string go, the first one too. Texts shorter than ``length``, empty and
    null texts stay whole; a row that repeats another is a repetition like any other. Other
    columns are not read.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), text_of().alias("text"))
    runs = repeated_windows(base, length, anchor)
    rows = base.join(runs, on_row(base, runs), "left").select(base["doc_id"], "text", "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                kept, spans, sizes = [], [], []
                for text, runs in zip(piece.column("text").to_pylist(), piece.column("runs").to_pylist()):
                    data = text.encode()
                    sizes.append(len(data))
                    gone = []
                    if runs:
                        pairs = np.array(runs, np.int64).reshape(-1, 2)
                        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
                        end = np.maximum.accumulate(pairs[:, 1] + length)
                        new = np.concatenate([[True], pairs[1:, 0] > end[:-1]])
                        first = pairs[new, 0]
                        last = end[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(end) - 1]])]
                        gone = np.stack([first, last], 1).tolist()
                    at, left = 0, []
                    for a, b in gone:
                        left.append(data[at:a])
                        at = b
                    kept.append(b"".join([*left, data[at:]]))
                    spans.append([{"start": a, "end": b} for a, b in gone])
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                    ],
                    ["doc_id", "n_bytes", "kept", "spans"],
                )

    return rows.mapInArrow(cut, "doc_id long, n_bytes long, kept binary, spans array<struct<start:int,end:int>>")


def digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows that the registered query returns."""
    return remove_repeats(docs.select("doc_id", "text")).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
