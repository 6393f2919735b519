"""Collocations against a plain version, on awkward rows, and the counting trie."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from reelyard.llm import collocations

from . import plain
from .test_documents import listed

SCHEMA = "doc_id long, text string, lang string, phrase string, block long, n int"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def corpus(seed=2):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "été", "d e", "x", "日本", "ΣΑΣ", "g-h"]
    rows = []
    for i in range(150):
        text = "".join(rng.choice(words[: 3 + i % 6]) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", "\x0b", ","]) for _ in range(60))
        rows.append((text, rng.choice(["en", "en", "en", "de", None, "und", ""])))
    rows += [(None, "en"), ("", "de"), (" \t .,;\n", "en"), ("the same row again " * 20, "en"), ("the same row again " * 20, "en")]
    rows += [("x " * 4000, "fr"), ("tie one. tie one. tie two. tie two. " * 6, "es"), ("only" * 500, "it")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, g, "clash", 1, 2) for i, (t, g) in enumerate(rows)], SCHEMA).repartition(5).cache()


@pytest.mark.parametrize("least,top,block_bytes,merge_keys", [(5, None, 1 << 22, 10**6), (3, 20, 1 << 10, 50)])
def test_against_plain(docs, rows, least, top, block_bytes, merge_keys):
    got = collocations.collocations(docs, least=least, top=top, block_bytes=block_bytes, merge_keys=merge_keys)
    assert got.columns == COLUMNS
    want = plain.phrase_scores(rows, least=least, top=top or 10**9)
    assert listed(got) == want and {r[0] for r in want} >= {"en", "de", "und", "fr"}


def test_other_lengths_and_containment(docs, rows):
    got = collocations.collocations(docs, longest=3, least=4, top=None, inside=60)
    assert listed(got) == plain.phrase_scores(rows, longest=3, least=4, top=10**9, inside=60)


def test_nothing_is_frequent_and_empty_table(spark, docs):
    assert listed(collocations.collocations(docs, least=10**6)) == []
    assert listed(collocations.digest(spark, spark.createDataFrame([], SCHEMA))) == []


@pytest.mark.parametrize("container,most", [(4, 30), (1, 1), (1000, 10**6)])
def test_trie_bursts_and_spills(container, most):
    rng = np.random.default_rng(container)
    trie = collocations.HatTrie(40, container=container, most=most)
    want = Counter()
    for _ in range(30):
        keys = np.concatenate([rng.integers(0, 50, 20), rng.integers(0, 1 << 40, 20), (7 << 30) + rng.integers(0, 200, 40)]).astype(np.uint64)
        want.update(keys.tolist())
        trie.add(*np.unique(keys, return_counts=True))
        assert trie.held <= most
    assert most > 1000 or trie.runs
    keys, counts = trie.counts()
    assert (np.diff(keys.astype(object)) > 0).all() and dict(zip(keys.tolist(), counts.tolist())) == want
