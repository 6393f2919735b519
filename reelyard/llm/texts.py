"""Byte-level helpers shared by the operators that work on Arrow batches inside tasks.

All of them see whole texts. A batch is cut between documents into pieces of about
``PIECE_BYTES`` so that the arrays of one piece stay small whatever the batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 18

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = np.ones(1, dtype=U)
_inverses = np.ones(1, dtype=U)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; a bijection."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse modulo 2**64."""
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        _powers = np.cumprod(np.concatenate([np.ones(1, U), np.full(size - 1, _BASE)]), dtype=U)
        _inverses = np.cumprod(np.concatenate([np.ones(1, U), np.full(size - 1, _INVERSE)]), dtype=U)
    return _powers[:n], _inverses[:n]


class RollingHash:
    """Hashes of any substring of a byte array in constant time each."""

    def __init__(self, data: np.ndarray, salt: int = 0):
        up, self._down = powers(len(data) + 1)
        self._salt = U(salt)
        total = np.cumsum((data.astype(U) + U(1 + salt)) * up[:-1], dtype=U)
        self._total = np.concatenate([np.zeros(1, U), total])

    def windows(self, size: int) -> np.ndarray:
        """Hashes of all runs of ``size`` bytes."""
        if len(self._total) <= size:
            return np.zeros(0, U)
        return mix((self._total[size:] - self._total[:-size]) * self._down[: len(self._total) - size])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self._total[ends] - self._total[starts]) * self._down[starts]
        return mix(raw + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93) + self._salt)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the offsets of its rows; null reads as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    if offsets is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)
    return held, at - at[0]


def pieces(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``PIECE_BYTES`` of text each; no row is left out."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    piece = np.cumsum(sizes, dtype=np.int64) // PIECE_BYTES
    cuts = np.flatnonzero(np.diff(piece)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        yield batch.slice(int(a), int(b - a))


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of lower-cased (A-Z) texts, as hashes in a flat array.

    ``first[i] : first[i + 1]`` are the words of text ``i``.
    """

    def __init__(self, texts: pa.Array):
        data, self.offsets = flat(texts)
        self.data = _LOWER[data]
        inside = ~_SPACE[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[self.offsets] = True
        before = np.concatenate([np.zeros(1, bool), inside])[:-1]
        after = np.concatenate([inside, np.zeros(1, bool)])[1:]
        self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.first[-1] = len(self.starts)
        self.hashes = RollingHash(self.data).of(self.starts, self.ends)

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        return runs_of_words(self.hashes, self.first, size)


def runs_of_words(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words and their row offsets.

    A text with fewer words, but at least one, has all its words as its only run.
    """
    count = np.diff(first)
    runs = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    begin = np.concatenate([np.zeros(1, np.int64), np.cumsum(runs)])
    at = np.arange(begin[-1]) - np.repeat(begin[:-1] - first[:-1], runs)
    length = np.repeat(np.minimum(count, size), runs)
    out = np.zeros(len(at), dtype=U)
    for k in range(size):
        use = length > k
        out[use] = mix(out[use] * U(3) + hashes[at[use] + k] + U(k + 1))
    return out, begin


def distinct_in_rows(values: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct values of each row."""
    out = []
    for a, b in zip(first[:-1], first[1:]):
        s = np.sort(values[a:b])
        out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s)
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
