"""The registered queries over the smallest tables, and the stages against plain rules."""

from __future__ import annotations

import random
from hashlib import sha256
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from reelyard.llm import bpe, mixing, queries

from . import plain
from .test_documents import line_rows

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


def test_sql_matches(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
    for name, sql in queries.oracle_sql().items():
        cursor = con.execute(sql)
        columns = [d[0] for d in cursor.description]
        got = queries.queries()[name](spark, SF_DIR)
        assert sorted(got.columns) == sorted(columns)
        assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, cursor.fetchall())), name


def test_all_are_registered():
    assert sorted(int(n.split("_")[0][2:]) for n in queries.queries()) == list(range(1, 14))


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    (_, select), (_, lines), (_, near), (_, mix), (_, encode) = corpus_pipeline.STAGES
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}

    first = select(spark, docs, SF_DIR).cache()
    assert first.columns == columns
    kept = {r.doc_id for r in first.select("doc_id").collect()}
    bad = [d for d, q in labels.items() if q == 0]
    assert sum(d in kept for d in bad) <= 0.2 * len(bad)

    second = lines(spark, first, SF_DIR).cache()
    assert second.columns == columns
    rows = [(r.doc_id, r.text) for r in first.collect()]
    got = second.select("doc_id", F.sha2("text", 256), "n_chars", F.length("text")).collect()
    assert sorted((r[0], r[1]) for r in got) == sorted((d, h) for d, _, _, h in line_rows(rows))
    assert all(r[2] == r[3] for r in got)

    third = near(spark, second, SF_DIR).cache()
    assert third.columns == columns
    rows = [(r.doc_id, r.text) for r in second.collect()]
    assert sorted(r.doc_id for r in third.collect()) == sorted(d for d, _, c in plain.near_duplicates(rows) if c == d)

    fourth = mix(spark, third, SF_DIR).cache()
    assert fourth.columns == columns
    counts = {r.doc_id: r["copies"] for r in mixing.copies(third).collect()}
    drawn = {r.doc_id: r["count"] for r in fourth.groupBy("doc_id").count().collect()}
    assert drawn == {d: n for d, n in counts.items() if n}

    tok = pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.vocabulary_path())
    tok.no_truncation()
    tok.no_padding()
    last = {r.doc_id: r.n_tokens for r in encode(spark, fourth, SF_DIR).collect()}
    assert last == {r.doc_id: len(tok.encode(r.text, add_special_tokens=False).ids) for r in fourth.collect()}


def test_near_duplicates_by_five_words(spark):
    """Pairs with a five-word similarity of 0.80 to 0.85 and others just below."""
    rng = random.Random(3)
    rows = []
    for i in range(12):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        edited = list(words)
        for at in range(4 if i % 2 else 5):  # five shingles go with each word
            edited[20 + at * 40] = f"x{i}x{at}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(edited))]
    sets = [plain.shingles(t, 5) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i)]
    alike = {p: len(sets[p[0]] & sets[p[1]]) / len(sets[p[0]] | sets[p[1]]) for p in pairs}
    links = [p for p in pairs if alike[p] >= 0.8]
    assert len(links) == 6 and all(0.8 <= alike[p] <= 0.85 for p in links) and any(0.7 < x < 0.8 for x in alike.values())
    three = [plain.shingles(t, 3) for _, t in rows]
    assert all(len(three[i] & three[j]) / len(three[i] | three[j]) < 0.9 for i, j in links)
    docs = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF_DIR).collect()}
    assert kept == {min(g) for g in plain.groups(len(rows), links)}


def test_last_stage_decodes(spark):
    tok = pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.vocabulary_path())
    texts = ["Hello, World's  they'll", "", None, "naïve 日本語"]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    for r in corpus_pipeline.encode(spark, docs, SF_DIR).collect():
        ids = tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.decoded_sha256 == sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_run_gives_the_rows_of_the_stages(spark):
    assert corpus_pipeline.run(spark, SF_DIR).columns == ["doc_id", "lang", "source", "n_tokens", "token_ids"]
