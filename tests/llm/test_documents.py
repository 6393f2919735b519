"""Operators on documents against plain versions, on awkward rows."""

from __future__ import annotations

import random
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelyard.llm import fingerprints, jaccard_join, line_dedup, lm_score, mixing, suffix_dedup
from reelyard.llm.blocks import range_slices

from . import plain

SCHEMA = "doc_id long, text string, source string, n_chars long, text_key string, row string, c int"
WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "été", "ΣΑΣ", "x"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def corpus(seed=5):
    rng = random.Random(seed)
    base = prose(rng, 200)
    passage = prose(rng, 90)
    rows = [(i, prose(rng, rng.randrange(1, 120))) for i in range(30)]
    rows += [(100 + i, base) for i in range(6)]  # exact copies
    for i in range(12):  # near copies, some of them under the threshold
        w = base.split()
        for k in range(i):
            w[rng.randrange(len(w))] = f"edit{i}{k}"
        rows.append((200 + i, " ".join(w)))
    rows += [(300 + i, prose(rng, 20) + "\n" + passage + "\n" + prose(rng, 30)) for i in range(8)]
    rows += [
        (400, None), (401, ""), (402, " \t\n "), (403, "\n\n"), (404, "one"), (405, "one"), (406, "One two"),
        (407, "a" * 3000), (408, "ab" * 700), (409, "ab" * 700 + "c"), (410, "é" * 450), (411, "ñ" + "é" * 450),
        (412, "Shared line of text\nshared LINE of text \nunique " + prose(rng, 3)), (413, "  shared line of text\nother"),
        (413, "a row with the same id\nshared line of text"), (414, "short\nshort\nshort"), (415, "short"),
        (416, prose(rng, 9000)), (None, base), (None, "no id here but text enough\nshared line of text"),
        (417, "repeated row\n" + passage), (417, "repeated row\n" + passage), (-5, "negative id\nshared line of text"),
    ]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    data = [(d, t, f"src{(d or 0) % 3}", 1, "clash", "clash", 7) for d, t in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def listed(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_near_duplicates(spark, docs, rows):
    assert listed(jaccard_join.digest(spark, docs)) == plain.near_duplicates(rows)


def test_one_per_group_keeps_all_columns_and_one_row(docs, rows):
    kept = jaccard_join.one_per_group(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id is not None)
    want = {(d, t) for (d, t) in rows if d is not None}
    component = {}
    for d, _, c in plain.near_duplicates(rows):
        component.setdefault(d, set()).add(c)
    assert [d for d, _ in got] == sorted(d for d, t in want if d in component[d])
    assert not kept.where("text_key != 'clash'").count()


def test_counts_over_several_buckets_and_blocks(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BUCKET_WORDS", 1500)
    assert listed(jaccard_join.digest(spark, docs.repartition(7))) == plain.near_duplicates(rows)


@pytest.mark.parametrize("order", range(3))
def test_families_of_near_copies(spark, order):
    rng = random.Random(order)
    base = prose(rng, 60).split()
    rows = []
    for i in range(60):  # chains of edits: links that no leader has
        w = list(base)
        for k in range(i // 4):
            w[(7 * k) % 60] = f"e{k}"
        rows.append((rng.randrange(10**6), " ".join(w + [f"t{rng.randrange(3)}"])))
    df = spark.createDataFrame([(d, t) for d, t in rows], "doc_id long, text string")
    assert listed(jaccard_join.digest(spark, df)) == plain.near_duplicates(rows)


def line_rows(rows, min_chars=10):
    strip = " \t\n\x0b\x0c\r"
    key = lambda line: line.strip(strip).translate(plain.LOWER)
    owner = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            k = key(line)
            if len(k) >= min_chars:
                owner.setdefault(k, set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        left = []
        for line in lines:
            low = plain.lowest(owner.get(key(line), ()))
            if len(key(line)) < min_chars or low is None or low == d:
                left.append(line)
        out.append((d, len(lines), len(lines) - len(left), sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches,fanout", [(3, 2), (1, 2), (5, 3)])
def test_lines(docs, rows, batches, fanout):
    got = line_dedup.dedup_lines(docs, batches=batches, fanout=fanout)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped", "kept_text"]
    assert listed(got.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256))) == line_rows(rows)


def test_runs_are_compacted_by_level(spark):
    runs = line_dedup.LineRuns(spark, fanout=2, buckets=4)
    for i in range(5):
        keys = spark.range(i * 10, i * 10 + 15).selectExpr("id as h1", "-id as h2")
        new = runs.unseen(keys)
        assert new.count() == (15 if i == 0 else 10)
        runs.add(new)
        plan = runs.unseen(keys)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") + plan.count("BroadcastHashJoin") == len(runs.tables())
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    runs.close()


def test_repeated_strings(spark, docs, rows):
    assert listed(suffix_dedup.digest(spark, docs)) == plain.repeats(rows)


def test_repeated_strings_of_other_lengths_and_split_anchors(spark, monkeypatch):
    rng = random.Random(3)
    passage = prose(rng, 12)
    rows = [(i, prose(rng, 6) + " " + passage[rng.randrange(9) :] + " " + prose(rng, 6)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(suffix_dedup, "SHARD_CONTEXTS", 5)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 800)
    got = suffix_dedup.remove_repeats(df, length=40, anchor=12).collect()
    want = {d: (n, k) for d, n, k, *_ in plain.repeats(rows, 40)}
    assert {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept)) for r in got} == want


@pytest.mark.parametrize("seed", range(4))
def test_suffix_array_and_common_prefixes(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(0, 2 + seed, 400).astype(np.int16)
    text[200:300] = text[50:150]
    text[:30] = 1
    order, rank = suffix_dedup.suffix_array(text)
    want = sorted(range(400), key=lambda i: text[i:].tolist())
    assert order.tolist() == want and rank[order].tolist() == list(range(400))
    shared = suffix_dedup.common_prefixes(text, order, rank)
    for k in range(1, 400):
        a, b = text[order[k - 1] :], text[order[k] :]
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        assert shared[k] == (differ[0] if len(differ) else n)


def test_scores(spark, docs, rows):
    got = [(d, n, off, round(s, 6)) for d, n, off, s, _ in listed(lm_score.digest(spark, docs))]
    assert sorted(got, key=str) == plain.backoff_scores(rows)


def test_scores_over_several_blocks_and_buckets(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(lm_score, "BUCKET_WORDS", 1500)
    got = [(d, n, off, round(s, 6)) for d, n, off, s, _ in listed(lm_score.digest(spark, docs.repartition(9)))]
    assert sorted(got, key=str) == plain.backoff_scores(rows)


def edit_rows(rows):
    known = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0])
    out = []
    for i, (d, t) in enumerate(known):
        nxt = known[(i + 1) % len(known)][1] or ""
        t = t or ""
        k = len(t) // 3
        edited = t[: len(t) - k] + nxt[:k]
        a, b, c = (str(fingerprints.Digest.of(x)) for x in (t, edited, nxt))
        out.append((d, len(t), sha256(edited.encode()).hexdigest(), a, b, fingerprints.likeness(a, b), fingerprints.likeness(a, c)))
    return sorted(out, key=str)


def test_fingerprints(spark, rows, monkeypatch):
    unique = [r for r in {d: (d, t) for d, t in rows if d is not None}.values()]
    df = frame(spark, unique)
    assert listed(fingerprints.digest(spark, df)) == edit_rows(unique)
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 7)
    assert listed(fingerprints.digest(spark, df)) == edit_rows(unique)


def test_fingerprints_of_repeated_and_null_ids(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 4)
    got = fingerprints.digest(spark, docs).collect()
    assert sorted((r.doc_id, r.n_chars) for r in got if r.doc_id is not None) == sorted((d, len(t or "")) for d, t in rows if d is not None)
    assert len(got) == len(rows)


def test_likeness_is_bounded_and_tells_texts_apart():
    rng = random.Random(1)
    a, b = prose(rng, 300), " ".join(str(rng.random()) for _ in range(300))
    fa, fb = (str(fingerprints.Digest.of(x)) for x in (a, b))
    assert fingerprints.likeness(fa, fa) == 1.0 and 0 <= fingerprints.likeness(fa, fb) < 0.5
    assert fingerprints.likeness(fa, str(fingerprints.Digest.of(a.replace("alpha", "omega", 9)))) > 0.5


def poisson(mean, u):
    p = below = np.exp(-mean)
    k = 0
    while below <= u and k < int(mean + 12 * np.sqrt(mean) + 25):
        k += 1
        p *= mean / k
        below += p
    return k


def test_poisson_counts(spark):
    rng = np.random.default_rng(0)
    data = [(float(m), float(u)) for m in (0.0, 0.2, 1.0, 7.5, 60.0, 300.0) for u in [0.0, *rng.random(40), 1 - 2**-52]]
    df = spark.createDataFrame(data, "m double, u double").select("m", "u", mixing.poisson_count(F.col("m"), F.col("u")).alias("k"))
    for r in df.collect():
        assert r.k == poisson(r.m, r.u) or r.u > 1 - 1e-12


def test_mixture(spark, docs):
    drawn = mixing.copies(docs, {"src0": 2.0, "src1": 1.0}, size=3.0)
    assert drawn.columns == [*docs.columns, "mean", "copies"] and drawn.count() == docs.count()
    means = {r.source: r["mean"] for r in drawn.select("source", "mean").distinct().collect()}
    sizes = {r.source: r.n for r in docs.groupBy("source").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("n")).collect()}
    total = sum(sizes.values())
    assert means["src2"] == 0 and means["src0"] == pytest.approx(2 / 3 * total * 3 / sizes["src0"])
    mixed = mixing.mix(docs, {"src0": 2.0, "src1": 1.0}, size=3.0)
    assert mixed.count() == drawn.agg(F.sum("copies")).first()[0]
    assert not mixed.where("source = 'src2'").count()


def test_mixture_repeats_at_the_target_rate(spark):
    df = spark.range(6000).selectExpr("id as doc_id", "'abcde' as text", "if(id % 3 = 0, 'a', 'b') as source")
    got = {r.source: r.n for r in mixing.mix(df, {"a": 1, "b": 1}).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(got["a"] - 3000) < 250 and abs(got["b"] - 3000) < 250


@pytest.mark.parametrize("run", [
    jaccard_join.digest, line_dedup.digest, suffix_dedup.digest, lm_score.digest, fingerprints.digest,
    lambda s, d: mixing.mix(d), lambda s, d: jaccard_join.one_per_group(d),
])
def test_empty_tables(spark, empty, run):
    assert run(spark, empty).collect() == []


@pytest.mark.parametrize("buckets", [1, 7, 1000, 10**6])
def test_bucket_slices_cover_sorted_keys(buckets):
    keys = np.unique(np.random.default_rng(buckets).integers(0, 1 << 50, 3000).astype(np.uint64))
    got = list(range_slices(keys, buckets, 50))
    assert [b for b, _ in got] == sorted({(int(k) >> 18) * buckets >> 32 for k in keys})
    assert np.concatenate([keys[at] for _, at in got]).tolist() == keys.tolist()
    assert not list(range_slices(keys[:0], buckets, 50))
