"""Grouping of spelling variants by composing the vocabulary with a one-edit transducer.

Pairs of words that differ by one code point are the pairs accepted by ``V o E o V``: the
minimised acceptor ``V`` of the vocabulary, a transducer ``E`` that inserts, deletes or
replaces one symbol, and the acceptor again. A state of the composition is a pair of states of
``V``; before the edit both are the same, after it both read the same symbols.

The vocabulary is cut by *initial states*. The edit of a pair whose shorter word has ``m`` code
points lies in the first ``m // 2`` of them or after those, so the words share either that
prefix or the rest as a suffix. A word goes to the partitions of its prefix and of its suffix
(which is then read backwards), for both lengths that its pairs can have. Partitions with more
than ``PARTITION_WORDS`` are cut again by the same rule, applied to what is left of the words.
Many partitions share one task and one acceptor, with an initial state each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import stored, text_of
from .texts import _LOWER, flat, pieces

SHORTEST = 7
LEAST = 2
#: A word stands for its near word only if that one is so many times as frequent.
RATIO = 10
#: One of so many runs, chosen by hash, loses a code point.
NOISE = 31
#: Words that one initial state may hold before it is cut further.
PARTITION_WORDS = 20_000
#: Rows of partitions that share a task, on average.
TASK_WORDS = 60_000
#: Runs longer than this are hashed one by one.
LONG_RUN = 64

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True


def crc_of_runs(data: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of every run, continued from the checksums ``state`` of what precedes it."""
    crc = state.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    size = end - start
    live = np.flatnonzero(size <= LONG_RUN)
    for k in range(LONG_RUN):
        live = live[size[live] > k]
        if not len(live):
            break
        crc[live] = _CRC[(crc[live] ^ data[start[live] + k]) & 255] ^ (crc[live] >> 8)
    crc ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > LONG_RUN):
        crc[i] = zlib.crc32(data[start[i] : end[i]].tobytes(), int(state[i]))
    return crc


def words_of(texts: pa.Array, ids: list, noise: int, shortest: int) -> pa.Array:
    """All words of at least ``shortest`` code points, one entry per occurrence."""
    data, offsets = flat(texts)
    lead = data == 0xC3  # first byte of U+00C0 to U+00FF
    inside = _LETTER[data] | lead
    inside[1:] |= lead[:-1]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(inside & (~np.concatenate([[False], inside[:-1]]) | edge[:-1])) if len(data) else np.zeros(0, np.int64)
    end = np.flatnonzero(inside & (~np.concatenate([inside[1:], [False]]) | edge[1:])) + 1 if len(data) else start
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    size = points[end] - points[start]
    long = size >= shortest
    start, end, size = start[long], end[long], size[long]
    data = _LOWER[data]
    doc = np.searchsorted(offsets, start, side="right") - 1
    heads = np.zeros(len(ids), np.uint32)
    for d in np.unique(doc):
        heads[d] = zlib.crc32(f"{'' if ids[d] is None else ids[d]}:".encode())
    crc = crc_of_runs(data, start, end, heads[doc])
    hit = crc % np.uint32(noise) == 0 if noise else np.zeros(len(crc), bool)
    cut = []
    for i in np.flatnonzero(hit & (size > shortest)):
        run = data[start[i] : end[i]].tobytes().decode()
        at = int(crc[i]) % len(run)
        cut.append(run[:at] + run[at + 1 :])
    start, end = start[~hit], end[~hit]
    cover = np.zeros(len(data) + 1, np.int8)
    cover[start] += 1
    cover[end] -= 1  # two runs meet only at the border of two texts
    held = data[np.cumsum(cover[:-1]) > 0]
    at = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    whole = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(held)))
    return pa.concat_arrays([whole, pa.array(cut, pa.large_string())])


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, noise: int = NOISE) -> DataFrame:
    """``word, n`` of the words with at least ``least`` occurrences in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = []
            for piece in pieces(batch, "text"):
                found = words_of(piece.column("text"), piece.column("doc_id").to_pylist(), noise, shortest).value_counts()
                counts.append(pa.table({"word": found.field("values").cast(pa.string()), "n": found.field("counts")}))
            if counts:
                merged = pa.concat_tables(counts).group_by("word").aggregate([("n", "sum")])
                yield from merged.select(["word", "n_sum"]).rename_columns(["word", "n"]).to_batches()

    base = docs.select("doc_id", text_of().alias("text"))
    counts = base.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= least)


class Acceptor:
    """A minimal acyclic acceptor with an initial state for each sorted list of strings.

    ``arcs[s]`` lists symbol, target and how many strings of ``s`` come before those of the arc,
    so that a path adds up to the place of its string in the list.
    """

    def __init__(self):
        self.arcs: list[tuple] = []
        self.final: list[bool] = []
        self.size: list[int] = []
        self._known: dict[tuple, int] = {}
        self._edits: dict[int, list] = {}

    def add(self, words: list[str]) -> int:
        """Initial state of sorted distinct ``words``."""
        path, before = [[False, []]], ""
        for word in words:
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            self._close(path, before, shared)
            path += [[False, []] for _ in range(len(word) - shared)]
            path[-1][0] = True
            before = word
        self._close(path, before, 0)
        return self._state(*path[0])

    def _close(self, path: list, word: str, depth: int) -> None:
        while len(path) - 1 > depth:
            state = self._state(*path.pop())
            path[-1][1].append((word[len(path) - 1], state))

    def _state(self, final: bool, arcs: list) -> int:
        known = (final, tuple(arcs))
        state = self._known.get(known)
        if state is None:
            state = self._known[known] = len(self.arcs)
            total, rows = int(final), []
            for symbol, target in arcs:
                rows.append((symbol, target, total))
                total += self.size[target]
            self.arcs.append(tuple(rows))
            self.final.append(final)
            self.size.append(total)
        return state

    def _shared(self, p: int, q: int, i: int, j: int, skip: str, out: list) -> None:
        """Places of the strings that ``p`` and ``q`` both accept and that don't begin with ``skip``."""
        stack = [(p, q, i, j)]
        while stack:
            p, q, i, j = stack.pop()
            if p == q and not skip:
                out += [(i + k, j + k) for k in range(self.size[p])]
                continue
            if self.final[p] and self.final[q]:
                out.append((i, j))
            if len(self.arcs[p]) == 1 == len(self.arcs[q]):  # a chain
                (a, x, m), (b, y, n) = self.arcs[p][0], self.arcs[q][0]
                if a == b != skip:
                    stack.append((x, y, i + m, j + n))
            else:
                other = {a: (y, n) for a, y, n in self.arcs[q]}
                for a, x, m in self.arcs[p]:
                    if a in other and a != skip:
                        y, n = other[a]
                        stack.append((x, y, i + m, j + n))
            skip = ""

    def edits_at(self, p: int) -> list[tuple[int, int]]:
        """Places of the pairs of strings of ``p`` whose edit is at their first symbol.

        Of the equal symbols in a row only the last counts as the deleted one.
        """
        out = self._edits.get(p)
        if out is None:
            out = self._edits[p] = []
            arcs = self.arcs[p]
            for k, (a, x, m) in enumerate(arcs):
                self._shared(x, p, m, 0, a, out)
                for _, y, n in arcs[k + 1 :]:
                    self._shared(x, y, m, n, "", out)
        return out

    def pairs(self, root: int) -> Iterator[tuple[int, int]]:
        """Places of all pairs of strings of an initial state that are one edit apart."""
        stack = [(root, 0)]
        while stack:
            p, i = stack.pop()
            if self.size[p] < 2:
                continue
            for x, y in self.edits_at(p):
                yield i + x, i + y
            stack += [(x, i + m) for _, x, m in self.arcs[p]]


def near_in_partitions(table: pa.Table) -> pa.Table:
    """Pairs ``a, b`` of near words, both ways round, of the partitions of one task."""
    rows = sorted(zip(*(table[c].to_pylist() for c in ("key", "rest", "word"))))
    acceptor = Acceptor()
    left, right = [], []
    i = 0
    while i < len(rows):
        j = i + 1
        while j < len(rows) and rows[j][0] == rows[i][0]:
            j += 1
        if j - i > 1:
            root = acceptor.add([r[1] for r in rows[i:j]])
            for x, y in acceptor.pairs(root):
                left.append(rows[i + x][2])
                right.append(rows[i + y][2])
        i = j
    return pa.table({"a": pa.array(left + right, pa.string()), "b": pa.array(right + left, pa.string())})


def cut_once(size: Column) -> Column:
    """The two partitions of a row ``key, rest`` whose shorter rests have ``size`` symbols."""
    half = F.floor(size / 2).cast("int")
    tail = (size - half).cast("int")
    length = F.length("rest")
    return F.array(
        F.struct(
            F.concat("key", F.lit("<"), F.substring("rest", F.lit(1), half)).alias("key"),
            F.substring("rest", half + 1, length).alias("rest"), tail.alias("left"),
        ),
        F.struct(
            F.concat("key", F.lit(">"), F.substring("rest", length - tail + 1, tail)).alias("key"),
            F.reverse(F.substring("rest", F.lit(1), length - tail)).alias("rest"), half.alias("left"),
        ),
    )


def initial_states(words: DataFrame, shortest: int, most: int) -> DataFrame:
    """``key, rest, word``: the partitions of every word and what is left of it there.

    ``key`` names the initial state: the length of the shorter word and the parts read so far.
    """
    sizes = F.array(F.length("word") - 1, F.length("word"))
    rows = words.select("word", F.col("word").alias("rest"), F.explode(F.filter(sizes, lambda m: m >= shortest)).alias("left"))
    rows = rows.withColumn("key", F.col("left").cast("string"))

    def cut(df: DataFrame) -> DataFrame:
        return df.select("word", F.explode(cut_once(F.col("left"))).alias("part")).select("word", "part.*")

    done, open_rows = None, cut(rows)
    while True:
        # what can't be cut holds two symbols at most besides its key
        crowded = stored(
            open_rows.where("left > 2").groupBy("key").count().where(F.col("count") > most).select("key"), "variant-crowded"
        )
        settled = open_rows.join(crowded, "key", "left_anti").select("key", "rest", "word")
        done = settled if done is None else done.unionByName(settled)
        if crowded.isEmpty():
            return done
        open_rows = stored(cut(open_rows.join(crowded, "key", "left_semi")), "variant-open")


def near_words(words: DataFrame, shortest: int = SHORTEST, most: int = PARTITION_WORDS, task: int = TASK_WORDS) -> DataFrame:
    """Pairs ``a, b`` of words, both ways round, that differ by exactly one code point.

    ``words.word`` holds distinct words of ``shortest`` code points or more.
    """
    rows = stored(initial_states(words, shortest, most), "variant-states")
    tasks = rows.count() // task + 1
    placed = rows.withColumn("task", F.pmod(F.xxhash64("key"), F.lit(tasks)))
    pairs = placed.groupBy("task").applyInArrow(near_in_partitions, "a string, b string")
    return pairs.distinct()


def variants(
    docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, ratio: int = RATIO, noise: int = 0,
    most: int = PARTITION_WORDS, task: int = TASK_WORDS,
) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of the words of ``docs``.

    Words are maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` of whole texts, A-Z lower-cased, with at
    least ``shortest`` code points and ``least`` occurrences (``n``). Words are near if exactly
    one inserted, deleted or replaced code point tells them apart. ``form`` is the near word of
    largest n (ties: the smallest in code-point order) if that n is at least ``ratio`` times the
    word's, else null; ``root`` is reached by following forms. Where ``noise`` is given, a run
    whose crc32 together with its doc_id (null: nothing) it divides loses one code point first.
    Null and empty texts have no words, a repeated row counts twice, an empty table gives no
    rows; columns but ``doc_id`` and ``text`` are not read.
    """
    words = stored(vocabulary(docs, shortest, least, noise), "variant-words")
    near = near_words(words.select("word"), shortest, most, task)
    near = near.join(words.select(F.col("word").alias("b"), "n"), "b")
    best = stored(
        near.groupBy("a").agg(
            F.count("*").alias("n_near"), F.max("n").alias("top"),
            F.min(F.struct((-F.col("n")).alias("n"), F.col("b").alias("word"))).alias("best"),
        ).select(F.col("a").alias("word"), "n_near", "top", F.col("best.word").alias("form")), "variant-best",
    )
    strong = F.col("top") >= ratio * F.col("n")
    found = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, F.col("form")).alias("form"), F.when(strong, F.col("top")).alias("form_n"),
    )
    found = stored(found, "variant-forms")
    # a form is ``ratio`` times as frequent as its word: chains are short, and halve with every round
    steps = found.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        steps = stored(steps, "variant-roots")
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if steps.join(ahead, "root", "left_semi").isEmpty():
            break
        steps = steps.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return found.join(steps, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows that the registered query returns."""
    return variants(docs.select("doc_id", "text"), noise=NOISE)
