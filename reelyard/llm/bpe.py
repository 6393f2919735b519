"""Encoding and decoding with a public byte-pair vocabulary of the "word ends" kind.

The words of a piece of text are numbered, and only words not seen before by the task are
encoded, many at a time: their symbols lie in one flat array, and every round looks up all
neighbouring pairs in the sorted pair keys by binary search, finds the lowest rank of each
word and merges there. A word leaves the array when no pair of it is known.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .texts import pieces

VOCABULARY = "word_bpe_49k.json"
#: Distinct words that a task remembers before it starts anew; memory only, not results.
REMEMBERED = 1 << 18
NONE = np.iinfo(np.int64).max


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Bytes that are printable in Latin-1 stand for themselves, the others for the
    characters from 256 on, in order.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def unassigned() -> np.ndarray:
    """For every code point, whether this Python's Unicode tables have no category for it."""
    codes = range(0x110000)
    return np.fromiter((unicodedata.category(chr(c)) == "Cn" for c in codes), bool, len(codes))


class WordBpe:
    """The encoding that a vocabulary file defines, given as its text.

    Supported are the parts such files have: NFC, white space and lower-case normalisation,
    a split pattern whose matches are kept, byte-level symbols and a suffix that marks the
    end of a word. Other settings raise ``ValueError``.
    """

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if (
            model["type"] != "BPE" or model["ignore_merges"] or model["byte_fallback"] or spec["decoder"]
            or kinds != ["NFC", "Replace", "Lowercase"] or not split["invert"] or split["behavior"] != "Removed"
            or level["type"] != "ByteLevel" or level["use_regex"] or level["add_prefix_space"]
            or any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
        ):
            raise ValueError("the vocabulary file has settings that this encoder doesn't know")
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [""] * self.size
        for token, number in [*vocab.items(), *self.special.items()]:
            self.tokens[number] = token
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self._pattern = regex.compile(split["pattern"]["Regex"])
        self._ascii = re.compile(  # the same pattern where all letters are a-z
            split["pattern"]["Regex"].replace(r"[\p{L}]", "[a-z]").replace(r"[\p{N}]", "[0-9]")
            .replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9"), re.ASCII,
        )
        suffix = model["end_of_word_suffix"]
        chars = byte_characters()
        self._byte = {c: b for b, c in enumerate(chars)}
        self._unknown = unassigned()
        # the same file without its tokens
        self._frame = json.dumps(spec | {"added_tokens": [], "model": model | {"vocab": {}, "merges": []}})
        self._inner = np.array([vocab[c] for c in chars], np.int64)
        self._last = np.array([vocab[c + suffix] for c in chars], np.int64)

        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        pairs = np.array([(vocab[a], vocab[b]) for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        ranks = np.arange(len(merges))
        key = pairs[:, 0] * self.size + pairs[:, 1]
        order = np.argsort(key, kind="stable")
        self._keys, self._ranks = key[order], ranks[order]
        self._made = made
        # A merge whose product takes part in a merge of lower rank must be done one place at
        # a time; all other merges of a word can be done at all places at once.
        used = np.full(self.size, len(merges))
        np.minimum.at(used, pairs.ravel(), np.repeat(ranks, 2))
        self._single = used[made] <= ranks

    def words(self, text: str) -> list:
        """The words of a text in order, special tokens as their numbers."""
        if "<|" not in text:
            return self._plain(text)
        out, at = [], 0
        for m in self._special.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append(self.special[m.group()])
            at = m.end()
        return out + self._plain(text[at:])

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return self._ascii.findall(text.lower())
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
        if self._unknown[codes].any():
            return self._library_split(text)
        # lower case by character: a final sigma has no form of its own here
        return self._pattern.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def _library_split(self, text: str) -> list[str]:
        """Words of a text with characters newer than this Python's Unicode tables.

        Which of them are letters depends on the tables of the library, so it is asked.
        """
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(self._frame)
        pieces = tok.pre_tokenizer.pre_tokenize_str(tok.normalizer.normalize_str(text))
        return [bytes(self._byte[c] for c in piece).decode() for piece, _ in pieces]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of many words in one array, and the number of tokens of each."""
        sizes = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        symbol = self._inner[data]
        ends = np.cumsum(sizes) - 1
        symbol[ends] = self._last[data[ends]]
        owner = np.repeat(np.arange(len(words)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            rank = np.full(len(symbol), NONE)
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            key = symbol[inner] * self.size + symbol[inner + 1]
            at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
            known = self._keys[at] == key
            rank[inner[known]] = self._ranks[at[known]]
            lowest = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.concatenate([starts, [len(symbol)]]))
            each = np.repeat(lowest, lengths)
            over = each == NONE
            if over.any():
                done.append((owner[over], symbol[over]))
                owner, symbol, rank, each = owner[~over], symbol[~over], rank[~over], each[~over]
            here = np.flatnonzero((rank == each) & (each != NONE))
            if not len(here):
                continue
            fresh = np.concatenate([[True], here[1:] != here[:-1] + 1])  # "a a a": every other pair
            nth = np.arange(len(here)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            first = np.concatenate([[True], owner[here[1:]] != owner[here[:-1]]])
            here = here[np.where(self._single[rank[here]], first, nth % 2 == 0)]
            symbol[here] = self._made[rank[here]]
            stay = np.ones(len(symbol), bool)
            stay[here + 1] = False
            owner, symbol = owner[stay], symbol[stay]
        if not done:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        owner, symbol = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(owner, kind="stable")
        return symbol[order], np.bincount(owner, minlength=len(words))

    def decode(self, ids: np.ndarray) -> str:
        """Tokens joined by a blank, as a vocabulary file without a decoder asks for."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


class _Numbers(dict):
    def __missing__(self, word):
        self[word] = number = len(self)
        return number


class Encoder:
    """Encodes texts one after another and remembers the words it has met."""

    def __init__(self, bpe: WordBpe):
        self.bpe = bpe
        self._forget()

    def _forget(self) -> None:
        self._numbers = _Numbers()
        self._flat = np.zeros(0, np.int64)
        self._start = np.zeros(0, np.int64)
        self._size = np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self._numbers) > REMEMBERED:
            self._forget()
        known = len(self._numbers)
        lookup = self._numbers.__getitem__
        seqs = [np.array(list(map(lookup, self.bpe.words(t))), np.int64) for t in texts]
        self._learn(list(self._numbers)[known:] if len(self._numbers) > known else [])
        out = []
        for seq in seqs:
            sizes = self._size[seq]
            before = np.cumsum(sizes) - sizes
            total = int(sizes.sum())
            out.append(self._flat[np.repeat(self._start[seq] - before, sizes) + np.arange(total)])
        return out

    def _learn(self, words: list) -> None:
        if not words:
            return
        plain = [w for w in words if isinstance(w, str)]
        flat, sizes = self.bpe.merge([w.encode() for w in plain])
        if len(plain) < len(words):
            parts = iter(np.split(flat, np.cumsum(sizes)[:-1]) if plain else [])
            each = [np.array([w], np.int64) if isinstance(w, int) else next(parts) for w in words]
            flat, sizes = np.concatenate(each), np.array([len(x) for x in each], np.int64)
        start = len(self._flat) + np.cumsum(sizes) - sizes
        self._flat = np.concatenate([self._flat, flat])
        self._start = np.concatenate([self._start, start])
        self._size = np.concatenate([self._size, sizes])


def shared_vocabulary(spark: SparkSession, path: str | None) -> Callable[[], WordBpe]:
    """What gives tasks the vocabulary of a file on the driver.

    The text of the file is broadcast, plain data that workers without this package can
    read, and the broadcast dictionary keeps what a worker has made of it for its next task.
    """
    with open(path or vocabulary_path(), encoding="utf-8") as file:
        text = file.read()
    WordBpe(text)  # settings that the encoder doesn't know fail here, not in tasks
    shared = spark.sparkContext.broadcast({"text": text})

    def get() -> WordBpe:
        held = shared.value
        if "bpe" not in held:
            held["bpe"] = WordBpe(held["text"])
        return held["bpe"]

    return get


def _with_columns(docs: DataFrame, names: list[str]) -> T.StructType:
    kept = [f for f in docs.schema.fields if f.name not in names]
    kinds = {"token_ids": T.BinaryType(), "decoded": T.StringType()}
    return T.StructType(kept + [T.StructField(n, kinds[n]) for n in names])


def encode(docs: DataFrame, path: str | None = None, decoded: bool = False) -> DataFrame:
    """``docs`` with ``token_ids``: the ids of the whole text as little-endian 32-bit values.

    The text stands in ``text``; null reads as empty and has no ids. Special tokens that
    stand in a text become their ids; none is added. With ``decoded`` the ids are decoded
    again into a column of that name. Existing columns of these names are replaced.
    """
    names = ["token_ids", *["decoded"] * decoded]
    schema = _with_columns(docs, names)
    kept = [f.name for f in schema.fields if f.name not in names]

    vocabulary = shared_vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary()
        encoder = Encoder(bpe)
        for batch in batches:
            for piece in pieces(batch, "text"):
                ids = encoder.encode(pc.fill_null(piece.column("text"), "").to_pylist())
                new = [pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())]
                if decoded:
                    new.append(pa.array([bpe.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays([piece.column(n) for n in kept] + new, kept + names)

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` with ``decoded``, the text that ``token_ids`` stand for; null ids are none."""
    schema = _with_columns(encoded, ["decoded"])
    kept = [f.name for f in schema.fields if f.name != "decoded"]

    vocabulary = shared_vocabulary(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary()
        for batch in batches:
            for piece in pieces(batch, "token_ids"):
                texts = [bpe.decode(np.frombuffer(x or b"", "<u4")) for x in piece.column("token_ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(piece.column(n) for n in kept), pa.array(texts, pa.string())], [*kept, "decoded"])

    return encoded.mapInArrow(run, schema)


def digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows that the registered query returns."""
    done = encode(docs.select("doc_id", "text"), decoded=True)
    return done.select(
        "doc_id", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
