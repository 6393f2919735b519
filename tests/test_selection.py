"""Selection and quality goldens."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from reelyard import dims
from reelyard.operators import quality, selection


def test_target_choice_on_the_linear_ladder(spark):
    ladder = [(1, q, 10 * q, True, "jpeg", q) for q in range(60, 101)]
    attempts = spark.createDataFrame(ladder, "file_id int, quality int, output_bytes bigint, decoded boolean, codec string, ordinal int")
    files = spark.createDataFrame([(1, 2000, 700)], "file_id int, size_bytes bigint, requested_bytes bigint")
    r = selection.select_for_target(attempts, files).first()
    assert (r.selected_quality, r.actual_bytes, r.achieved, r.within_tolerance, r.attempts) == (70, 700, True, True, 41)
    missed = selection.select_for_target(attempts, files.withColumn("requested_bytes", F.lit(500).cast("bigint"))).first()
    assert (missed.outcome, missed.selected_quality, missed.achieved, missed.smallest_bytes) == ("floor-misses-target", 60, False, 600)
    report = selection.target_report(selection.select_for_target(attempts, files.withColumn("requested_bytes", F.lit(500).cast("bigint")))).first()
    assert (report.minimum_achievable_bytes, report.difference_bytes) == (600, 100)
    assert report.alternatives == "lower-quality-floor,keep-best-quality,change-target"


def test_target_edges(spark):
    attempts = spark.createDataFrame([(1, 80, 900, True, "jpeg", 1), (2, 50, 10, True, "jpeg", 1), (3, 80, 10, False, "jpeg", 1)],
                                     "file_id int, quality int, output_bytes bigint, decoded boolean, codec string, ordinal int")
    files = spark.createDataFrame([(1, 800, 400), (2, 800, 400), (3, 800, 400), (4, 800, 800)], "file_id int, size_bytes bigint, requested_bytes bigint")
    got = {r.file_id: (r.outcome, r.actual_bytes, r.attempts) for r in selection.select_for_target(attempts, files).collect()}
    assert got == {1: ("original-kept", 800, 1), 2: ("original-kept", 800, 0), 3: ("original-kept", 800, 0), 4: ("no-reduction-needed", 800, 0)}


def test_lossless_reasons_and_ties(spark):
    cands = spark.createDataFrame(
        [(1, 2, 50, True, True), (1, 1, 50, True, True), (2, 1, 200, True, True), (3, 1, 10, True, False), (4, 1, 50, True, True), (5, 1, 500, True, True)],
        "file_id int, ordinal int, output_bytes bigint, eligible boolean, verified boolean")
    files = spark.createDataFrame([(1, 100, False, True), (2, 100, False, False), (3, 100, True, False), (4, 100, True, True), (5, 100, True, True)],
                                  "file_id int, size_bytes bigint, strip_privacy boolean, has_privacy boolean")
    got = {r.file_id: (r.selected_ordinal, r.output_bytes, r.reason) for r in selection.select_lossless(cands, files).collect()}
    assert got == {
        1: (1, 50, "smaller-verified"), 2: (None, 100, "verified-not-smaller"), 3: (None, 100, "no-verified-candidate"),
        4: (1, 50, "smaller-verified-privacy"), 5: (None, 100, "privacy-not-removed"),
    }


def test_png_order(spark):
    attempts = spark.createDataFrame([(1, 0, 90, True), (1, 1, 60, True), (1, 2, 40, True), (2, 0, 95, True), (2, 2, 90, True), (3, 0, 200, True)],
                                     "file_id int, format_rank int, output_bytes bigint, decoded boolean")
    files = spark.createDataFrame([(1, 100, 70), (2, 100, 50), (3, 100, 50)], "file_id int, size_bytes bigint, requested_bytes bigint")
    got = {r.file_id: (r.outcome, r.selected_format, r.actual_bytes, r.achieved) for r in selection.select_png(attempts, files).collect()}
    assert got == {1: ("lossless-fits", "webp", 60, True), 2: ("smallest-lossless", "avif", 90, False), 3: ("original-kept", None, 100, False)}
    lossy = {r.file_id: r.outcome for r in selection.select_png(attempts, files, allow_lossy=True).collect()}
    assert lossy[2] == "lossy-search"


def test_copy_decisions(spark):
    copies = spark.createDataFrame([(1, 90, True), (2, 110, True), (3, 110, True), (4, 90, False)], "file_id int, output_bytes bigint, verified boolean")
    files = spark.createDataFrame([(i, 100) for i in range(1, 5)], "file_id int, size_bytes bigint")
    removals = spark.createDataFrame([(3,), (3,)], "file_id int")
    got = {r.file_id: (r.decision, r.output_bytes) for r in selection.select_copy(copies, files, removals).collect()}
    assert got == {1: ("copied", 90), 2: ("grew-without-removal", 100), 3: ("removal-over-size", 110), 4: ("hash-mismatch", 100)}


def test_quality_gate(spark):
    cands = spark.createDataFrame(
        [(1, 1, "av1", 50, 96.0, 81.0), (1, 2, "h264", 40, 96.0, 79.0), (2, 1, "av1", 150, 99.0, 99.0), (3, 1, "av1", 10, None, None)],
        "file_id int, ordinal int, codec string, output_bytes bigint, vmaf_mean double, vmaf_min double")
    files = spark.createDataFrame([(i, 100) for i in (1, 2, 3)], "file_id int, size_bytes bigint")
    got = {r.file_id: (r.decision, r.selected_codec, r.output_bytes) for r in selection.select_quality(cands, files).collect()}
    assert got == {1: ("qualified", "av1", 50), 2: ("not-smaller", None, 100), 3: ("none-qualified", None, 100)}


def test_candidates_of_a_host(spark):
    files = spark.createDataFrame([(1, 7), (2, 8)], "file_id int, host int")
    caps = spark.createDataFrame([(7, "encoder", "libsvtav1"), (7, "encoder", "libx264")], "host int, section string, name string")
    rows = selection.enumerate_candidates(files, caps).collect()
    assert len(rows) == 2 * len(dims.CRF_LADDER)
    one = {(r.codec, r.encoder, r.available) for r in rows if r.file_id == 1}
    assert one == {("av1", "libsvtav1", True), ("h265", "libx265", False), ("h264", "libx264", True)}
    assert not any(r.available for r in rows if r.file_id == 2)


def test_candidates_follow_the_options(spark):
    files = spark.createDataFrame(
        [(1, 7, True, False, None, "slow", True), (2, 7, False, False, False, "slow", True), (3, 7, False, False, True, "ultrafast;delete", False)],
        "file_id int, host int, include_av1 boolean, include_h265 boolean, include_h264 boolean, preset string, ffmpeg_available boolean")
    caps = spark.createDataFrame([(7, "encoder", n) for n in ("libsvtav1", "libx265", "libx264")], "host int, section string, name string")
    rows = selection.enumerate_candidates(files, caps).collect()
    one = [r for r in rows if r.file_id == 1]
    assert [(r.codec, r.crf) for r in one] == [("av1", c) for c in (18, 22, 26, 30)] + [("h264", c) for c in (16, 18, 20)]
    assert all(r.available and r.preset == "slow" and r.unavailable_reason is None for r in one)
    assert one[0].label == "AV1 CRF 18"
    assert not [r for r in rows if r.file_id == 2]
    three = [r for r in rows if r.file_id == 3]
    assert {(r.codec, r.preset, r.available) for r in three} == {("h264", "medium", False)}
    assert all(r.unavailable_reason.startswith("libx264") for r in three)


def test_the_kept_candidate_is_selected(spark):
    cands = spark.createDataFrame(
        [(1, 1, "av1", 50, 96.0, 81.0), (1, 1, "av1", 50, 96.0, 81.0), (1, 2, "h264", 40, 96.0, 79.0), (2, 1, "av1", 150, 99.0, 99.0),
         (3, 1, "av1", None, None, None), (9, 1, "av1", 5, 99.0, 99.0)],
        "file_id int, ordinal int, codec string, output_bytes bigint, vmaf_mean double, vmaf_min double")
    files = spark.createDataFrame([(i, 100, "archive") for i in (1, 2, 3, 4)], "file_id int, size_bytes bigint, mode string")
    got = sorted(tuple(r) for r in selection.report_tally(cands, files).collect() if r.mode)
    assert got == [("archive", "av1", "qualified", 2, 200), ("archive", "av1", "selected", 1, 50), ("archive", "av1", "unavailable", 1, 0), ("archive", "h264", "rejected", 1, 40)]
    rest = [tuple(r) for r in selection.report_tally(cands, files).collect() if r.mode is None]
    assert rest == [(None, "av1", "qualified", 1, 5)]


def test_low_segments_golden(spark):
    df = spark.createDataFrame([(1, i, float(s)) for i, s in enumerate([98, 79, 75, 97, 0, 0, 78])], "candidate_id int, frame bigint, score double")
    df = df.filter("frame NOT IN (4, 5)")
    got = sorted((r.start_s, r.end_s, r.score) for r in quality.low_segments(df, 80, 2).collect())
    assert got == [(0.5, 1.5, 75.0), (3.0, 3.5, 78.0)]
    single = quality.low_segments(df.filter("frame = 1"), 80, 0.0).first()
    assert (single.start_s, single.end_s) == (1.0, 2.0)


def test_segments_across_chunks_match_a_scan(spark):
    rng = random.Random(3)
    scores = [rng.choice([70.0, 75.0, 90.0]) for _ in range(300)]
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(scores)], "candidate_id int, frame bigint, score double")
    want, run = [], None
    for i, s in enumerate(scores + [99.0]):
        if s < 80:
            run = (run[0], i, min(run[2], s)) if run else (i, i, s)
        elif run:
            want.append(run)
            run = None
    got = sorted((r.first_frame, r.last_frame, r.score) for r in quality.low_segments(df, 80, 1, size=11).collect())
    assert got == want


def test_pooled_scores_win(spark):
    frames = spark.createDataFrame([(1, 0, 90.0), (1, 1, 80.0), (2, 0, 70.0), (3, 0, None)], "candidate_id int, frame bigint, score double")
    pooled = spark.createDataFrame([(2, 99.0, 98.0), (4, 50.0, 40.0)], "candidate_id int, pooled_mean double, pooled_min double")
    got = {r.candidate_id: (r.mean_score, r.min_score) for r in quality.pool_scores(frames, pooled).collect()}
    assert got == {1: (85.0, 80.0), 2: (99.0, 98.0), 4: (50.0, 40.0)}


def test_pixel_error(spark):
    a = spark.createDataFrame([(1, [0, 10, 20]), (2, [5, 5]), (3, [1])], "image_id int, pixels array<int>")
    b = spark.createDataFrame([(1, [0, 10, 23]), (2, [5, 5]), (3, [1, 2])], "image_id int, pixels array<int>")
    got = {r.image_id: (r.comparable, r.psnr, r.infinite) for r in quality.pixel_error(a, b).collect()}
    assert got == {1: (True, 43.36, False), 2: (True, None, True), 3: (False, None, False)}


def test_codec_whitelist(spark):
    items = spark.createDataFrame([("mp4", "video", "vp9"), ("mp4", "video", "av1"), ("mov", "audio", "pcm")], "container string, stream string, codec string")
    bad = selection.codec_violations(items, dims.format_codecs(spark)).collect()
    assert [tuple(r) for r in bad] == [("mp4", "video", "vp9")]


def test_lossless_choice_hashes_and_breaks_ties_by_ordinal(spark):
    big = 9_007_199_254_740_991
    cands = spark.createDataFrame(
        [(1, 7, big, True, True), (1, 2, big, True, True), (1, 2_147_483_647, big - 1, True, False), (2, 0, 5, True, True)],
        "file_id long, ordinal int, output_bytes long, eligible boolean, verified boolean",
    )
    files = spark.createDataFrame([(1, big + 1, False, False), (2, 5, False, False)], "file_id long, size_bytes long, strip_privacy boolean, has_privacy boolean")
    chosen = selection.select_lossless(cands, files)
    got = {r.file_id: (r.selected_ordinal, r.output_bytes) for r in chosen.collect()}
    assert got == {1: (2, big), 2: (None, 5)}
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    with pytest.raises(Exception, match="ordinal out of range"):
        selection.select_lossless(cands.withColumn("ordinal", F.lit(-1)), files).collect()


def test_segments_with_a_threshold_of_each_file(spark):
    frames = spark.createDataFrame(
        [(c, f, float(50 + f)) for c in ("a", "b", "c") for f in range(5)], "candidate_id string, frame long, score double"
    )
    limit = F.when(F.col("candidate_id") == "a", 52.0).when(F.col("candidate_id") == "b", 54.0)
    got = sorted((r.candidate_id, r.first_frame, r.last_frame) for r in quality.low_segments(frames, limit).collect())
    assert got == [("a", 0, 1), ("b", 0, 3)]
