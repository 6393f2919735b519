"""Every registered query against its SQL check on the smallest tables."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from compare import FAMILY, TABLES, table_rows  # noqa: E402
from reelyard.catalogue import entries  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", list(entries()))
def test_query_matches_its_sql(spark, tables, name):
    item = entries()[name]
    df = item.run(spark, SF_DIR)
    got = df.collect()
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    cursor = tables.execute(item.sql)
    want_types = {d[0]: str(d[1]).lower() for d in cursor.description}
    assert {c: FAMILY.get(t, t) for c, t in types.items()} == {c: FAMILY.get(t, t) for c, t in want_types.items()}
    assert table_rows(list(types), got) == table_rows(list(want_types), cursor.fetchall())


def test_ids_of_the_inventory_are_registered():
    ids = {name.split("_")[0] for name in entries()}
    wanted = (
        [f"s{i}" for i in range(1, 13)] + ["k1", "k2", "k3"] + [f"p{i}" for i in range(1, 13)]
        + [f"j{i}" for i in range(1, 17)] + [f"a{i}" for i in range(1, 14)] + [f"w{i}" for i in range(1, 14)]
        + [f"t{i}" for i in range(1, 8)] + [f"u{i}" for i in range(1, 5)] + [f"b{i}" for i in range(1, 11)]
        + ["x1", "x2", "x3", "x4", "x5", "x6", "x7", "f1"]
    )
    assert sorted(set(wanted) - ids) == []


def test_stream_hashes_are_counted_without_a_join(spark):
    from reelyard.operators import verification

    rows = [(1, "a"), (1, " a"), (1, "b"), (2, "c"), (None, "n"), (2, "# x"), (2, None)]
    before = spark.createDataFrame(rows, "file_id bigint, hash string")
    after = spark.createDataFrame([(1, "a"), (2, "c "), (None, "n")], "file_id bigint, hash string")
    out = verification.verify_streams(before, after)
    got = {r.file_id: (r.input_streams, r.output_streams, r.missing_streams, r.extra_streams, r.verified) for r in out.collect()}
    assert got == {1: (3, 1, 2, 0, False), 2: (1, 1, 0, 0, True), None: (1, 1, 1, 1, False)}
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_reported_tags_keep_their_place_after_the_ranking(spark):
    from reelyard.operators import verification

    tags = spark.createDataFrame([(1, 0, "Make", "x"), (1, 1, "GPSLatitude", "y"), (2, 0, "Make", "z")], "file_id bigint, pos int, key string, value string")
    detected = spark.createDataFrame([(1, "EXIF"), (1, "EXIF"), (1, "XMP")], "file_id bigint, grp string")
    out = verification.metadata_report(tags, detected)
    assert sorted((r.file_id, r.pos, r.grp) for r in out.collect()) == [(1, 0, "EXIF"), (1, 1, "GPS")]
    plan = out.hint("merge")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter, (file_id" in plan and "grp" not in plan.split("Join LeftOuter, ")[1].splitlines()[0]


@pytest.mark.parametrize("name", [
    "k2_upsert_latest",
    "s7_stream_progress",
    "x1_ingest",
    "x2_track_jobs",
    "x3_state_expiry",
    "x4_stream_stalled_jobs",
    "x5_stream_overall",
    "x6_stream_late_events",
    "x7_stream_blocks",
])
def test_streams_run_where_the_session_sets_no_shuffle_partitions(spark, tables, name):
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.unset(key)
    try:
        test_query_matches_its_sql(spark, tables, name)
        assert spark.conf.get(key, None) is None
    finally:
        spark.conf.set(key, before)
