"""Spelling variants against a plain version, on awkward words."""

from __future__ import annotations

import random
from pathlib import Path

import pytest

from reelyard.llm import spelling

from . import plain
from .test_documents import SCHEMA, listed

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def edited(rng, word, letters):
    at = rng.randrange(len(word))
    kind = rng.randrange(3)
    return word[:at] + (rng.choice(letters) if kind else "") + word[at + (kind < 2) :]


def corpus(seed=1):
    rng = random.Random(seed)
    letters = "abÀéÿ×÷"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 15))) for _ in range(40)]
    base += ["aaaaaaa", "aaaaaaaa", "abababab", "babababa", "a" * 80, "a" * 79, "b" + "a" * 79, "é" * 300, "é" * 299 + "è"]
    words = base + [edited(rng, rng.choice(base), letters) for _ in range(300)]
    rows = []
    for i in range(120):
        some = [rng.choice(words) for _ in range(40)] + [words[min(i // 8, 8)]] * 12
        rows.append((i, rng.choice([" ", "-", "1", "\n", "_"]).join(w.upper() if rng.random() < 0.1 else w for w in some)))
    rows += [(200, None), (201, ""), (202, " 12 \n"), (None, "Nullidword nullidword aaaaaaa"), (None, "nullidword")]
    rows += [(203, "aaaaaaaé aaaaaaaé"), (203, "aaaaaaaé aaaaaaaé"), (204, "ĀbcdefghĀ bcdefgh" * 2), (-7, "negative negativ negative")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(d, t, "s", 1, "clash", "clash", 7) for d, t in rows], SCHEMA).repartition(5).cache()


def test_registered_form(spark, docs, rows):
    got = spelling.digest(spark, docs)
    assert got.columns == COLUMNS
    assert listed(got) == plain.spelling_variants(rows)


@pytest.mark.parametrize("most,task", [(1, 10), (3, 10**6), (10**6, 40)])
def test_partitions_are_cut_without_loss(docs, rows, most, task):
    assert listed(spelling.variants(docs, noise=31, most=most, task=task)) == plain.spelling_variants(rows)


def test_other_limits(docs, rows):
    got = spelling.variants(docs, shortest=4, least=1, ratio=2)
    assert listed(got) == plain.spelling_variants(rows, noise=0, shortest=4, least=1, ratio=2)


def test_ties_go_to_the_smallest_form(spark):
    text = " ".join(["abcdefx"] * 20 + ["abcdefy"] * 20 + ["abcdefz"] * 2 + ["abcdefzz"] * 2)
    got = {r.word: (r.form, r.root, r.n_near, r.form_n) for r in spelling.variants(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    assert got["abcdefz"] == ("abcdefx", "abcdefx", 3, 20)
    assert got["abcdefx"] == (None, "abcdefx", 2, None)
    assert got["abcdefzz"] == (None, "abcdefzz", 1, None)


def test_chains_of_forms_end_at_their_root(spark):
    counts = {"aaaaaaa": 2, "aaaaaab": 20, "aaaaabb": 200, "aaaabbb": 2000, "aaabbbb": 20000}
    rows = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(counts.items())]
    got = spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.root for r in got} == {"aaabbbb"}


def test_empty_table(spark):
    assert listed(spelling.digest(spark, spark.createDataFrame([], SCHEMA))) == []


def test_acceptor_is_minimal_and_places_its_strings():
    a = spelling.Acceptor()
    one, two = a.add(["ac", "bc", "c"]), a.add(["xc"])
    assert len(a.arcs) == 4  # the end, c, the first list, the second
    assert sorted(a.pairs(one)) == [(0, 1), (0, 2), (1, 2)]
    assert list(a.pairs(two)) == []


SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")
def test_over_the_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert listed(spelling.digest(spark, docs)) == plain.spelling_variants([(r.doc_id, r.text) for r in docs.collect()])
