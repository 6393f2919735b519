"""Planning goldens."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from reelyard import dims
from reelyard.functions import labels
from reelyard.functions.numbers import fixed, half_up, saved_percent
from reelyard.plans import batches, bitrate, resolution

MIB = 1024 * 1024
FILE = (
    "file_id bigint, kind string, size_bytes bigint, duration_s double, width int, height int,"
    " fps double, audio_track_count int, audio_kbps int, requested_bytes bigint, audio_mode string, codec string"
)


def plan(spark, target, mode="auto", **changes):
    row = dict(
        file_id=1, kind="video", size_bytes=100 * MIB, duration_s=120.0, width=3840, height=2160,
        fps=30.0, audio_track_count=2, audio_kbps=512, requested_bytes=target, audio_mode=mode, codec="h264",
    )
    row.update(changes)
    return bitrate.plan_bitrates(spark.createDataFrame([row], FILE))


def test_rounding(spark):
    r = spark.range(1).select(
        half_up(F.lit(-0.5)).alias("a"), half_up(F.lit(2.5)).alias("b"),
        fixed(F.lit(-0.04), 1).cast("string").alias("c"), fixed(F.lit(-2.25), 1).alias("d"),
        saved_percent(F.lit(480_000_000), F.lit(156_000_000)).alias("e"),
        saved_percent(F.lit(100), F.lit(125)).alias("f"),
        saved_percent(F.lit(0), F.lit(10)).alias("g"),
        saved_percent(F.lit(0), F.lit(10), 0.0).alias("h"),
        saved_percent(F.lit(100), F.lit(-1)).alias("i"),
    ).first()
    assert (r.a, r.b, r.c, r.d) == (0, 3, "0.0", -2.3)
    assert (r.e, r.f, r.g, r.h, r.i) == (67.5, -25.0, None, 0.0, None)


def test_labels(spark):
    r = spark.range(1).select(
        labels.byte_label(F.lit(512)).alias("a"), labels.byte_label(F.lit(-1536)).alias("b"),
        labels.byte_label(F.lit(5 * 1024**3)).alias("c"), labels.bitrate_label(F.lit(1_250_000)).alias("d"),
        labels.bitrate_label(F.lit(None).cast("double")).alias("e"),
        labels.elapsed_label(F.lit(3723.4)).alias("f"), labels.media_time_label(F.lit(3723.9)).alias("g"),
        labels.media_time_label(F.lit(65.0)).alias("h"),
    ).first()
    assert tuple(r) == ("512 B", "-1.5 KB", "5.00 GB", "1.25 Mbps", "unknown", "1h 2m 3s", "1:02:03", "1:05")


def test_bitrate_plan_keeps_audio_and_lowers_it_only_when_needed(spark):
    wide = plan(spark, 15 * MIB).first()
    assert (wide.audio_kbps_per_track, wide.audio_kbps_total, wide.feasible) == (256, 512, True)
    assert wide.gross_kbps == pytest.approx(15 * MIB * 8 / 120 / 1000, abs=0.05)
    assert wide.video_kbps == int(wide.usable_kbps - 512)
    tight = plan(spark, 4 * MIB).first()
    assert (tight.audio_kbps_per_track, tight.feasible) == (64, False)
    silent = plan(spark, 15 * MIB, "remove").first()
    assert (silent.remove_audio, silent.audio_kbps_total, silent.audio_kbps_per_track) == (True, 0, None)
    no_tracks = plan(spark, 15 * MIB, audio_track_count=0).first()
    assert no_tracks.remove_audio and no_tracks.track_count == 0


def test_zero_duration_and_size_are_not_planned(spark):
    assert plan(spark, 15 * MIB, duration_s=0.0).count() == 0
    assert plan(spark, 15 * MIB, size_bytes=0).count() == 0


def test_ratio_out_of_bounds_uses_the_default(spark):
    files = plan(spark, 15 * MIB).select(*[c.split()[0] for c in FILE.split(", ")])
    odd = bitrate.plan_bitrates(files, safety_margin=0.4, container_overhead=-1).first()
    assert odd.usable_kbps == plan(spark, 15 * MIB).first().usable_kbps


def test_targets_and_rejects(spark):
    rows = [
        (1, 1000, 400, None), (2, 1000, None, 0.25), (3, 1000, None, 0.0001), (4, 0, 10, None),
        (5, 1000, -1, None), (6, 1000, None, None), (7, 1000, None, float("nan")), (8, 2**53, 5, None),
    ]
    df = spark.createDataFrame(rows, "file_id int, size_bytes bigint, target_bytes bigint, target_ratio double")
    got = {r.file_id: (r.requested_bytes, r.reject_reason) for r in bitrate.resolve_targets(df).collect()}
    assert got == {
        1: (400, None), 2: (250, None), 3: (1, None), 4: (None, "invalid-original"),
        5: (None, "invalid-target"), 6: (None, "invalid-ratio"), 7: (None, "invalid-ratio"),
        8: (None, "invalid-original"),
    }
    assert bitrate.rejected(bitrate.resolve_targets(df)).count() == 5
    by_preset = bitrate.resolve_targets(df.filter("file_id = 6"), F.lit("cloud")).first()
    assert by_preset.requested_bytes == 750


def test_audio_only_plan(spark):
    rows = [(1, 0.02), (2, 0.5), (3, 2.0)]
    df = spark.createDataFrame(
        [(i, "audio", 10_000_000, 100.0, 2, None, int(10_000_000 * r)) for i, r in rows],
        "file_id int, kind string, size_bytes bigint, duration_s double, audio_track_count int, audio_kbps int, requested_bytes bigint",
    )
    got = {r.file_id: (r.outcome, r.step_kbps, r.minimum_bytes) for r in bitrate.plan_audio(df).collect()}
    assert got == {
        1: ("unreachable", None, 1_600_000), 2: ("planned", 128, None), 3: ("already-within-target", None, None),
    }


def test_resolution(spark):
    df = spark.createDataFrame(
        [(1, 3840, 2160, 30.0, "h264", 5000), (2, 3840, 2160, 30.0, "h264", 100), (3, 640, 360, None, "av1", 10),
         (4, 1920, 1080, 60.0, "av1", 9000)],
        "file_id int, width int, height int, fps double, codec string, video_kbps int",
    )
    rows = resolution.resolution_candidates(df, 720).filter("file_id = 1").orderBy(F.desc("candidate_height")).collect()
    assert [(r.candidate_height, r.candidate_width, r.minimum_kbps, r.is_source) for r in rows] == [
        (2160, 3840, 12000, True), (1440, 2560, 7000, False), (1080, 1920, 4000, False), (720, 1280, 2000, False),
    ]
    got = {r.file_id: (r.recommended_height, r.selected_height, r.will_change) for r in resolution.recommend_resolution(df).collect()}
    assert got == {1: (1080, 1080, True), 2: (480, 480, True), 3: (None, 360, False), 4: (None, 1080, False)}
    kept = resolution.recommend_resolution(df, allow_change=False).filter("file_id = 2").first()
    assert (kept.recommended_height, kept.selected_height) == (480, 2160)


def test_feasibility_bands(spark):
    rows = [(1, 100, 100, 10), (2, 100, 70, 10), (3, 100, 40, 10), (4, 100, 20, 10), (5, 100, 20, 22), (6, 100, 20, 90)]
    df = spark.createDataFrame(rows, "file_id int, size_bytes bigint, requested_bytes bigint, minimum_bytes bigint")
    got = {r.file_id: (r.feasibility, r.quality_impact) for r in bitrate.feasibility(df).collect()}
    assert got == {
        1: ("achievable", "none"), 2: ("achievable", "small"), 3: ("settings-recommended", "moderate"),
        4: ("quality-risk", "large"), 5: ("quality-risk", "large"), 6: ("difficult", "large"),
    }


def test_sample_windows_and_estimate(spark):
    df = spark.createDataFrame([(1, 100.0), (2, 2.0), (3, 0.0)], "file_id int, duration_s double")
    got = sorted((r.file_id, r.start_s, r.window_s) for r in bitrate.sample_windows(df, 3).collect())
    assert got == [(1, 0.0, 3.0), (1, 48.5, 3.0), (1, 97.0, 3.0), (2, 0.0, 2.0)]
    samples = spark.createDataFrame(
        [(1, 3.0, 300_000, 1.0), (1, 3.0, 330_000, 1.0), (1, 3.0, 270_000, None)],
        "file_id int, duration_s double, output_bytes bigint, processing_s double",
    )
    files = spark.createDataFrame([(1, 100.0, 20_000_000, 11_000_000)], "file_id int, duration_s double, size_bytes bigint, requested_bytes bigint")
    r = batches.estimate_from_samples(samples, files).first()
    assert (r.estimated_output_bytes, r.feasibility, r.quality_impact) == (10_000_000, "achievable", "moderate")


def test_presets_and_use_case(spark):
    files = spark.createDataFrame(
        [(1, "image", 12 * MIB, None, 6000, 4000, True), (2, "video", 100 * MIB, 60.0, 1920, 1080, False)],
        "batch_id int, kind string, size_bytes bigint, duration_s double, width int, height int, has_alpha boolean",
    )
    analysed = batches.analyze_batches(files)
    use = {r.batch_id: r.use_case for r in batches.recommend_use_case(analysed).collect()}
    assert use == {1: "web", 2: "smartphone"}
    got = {(r.batch_id, r.preset_id): r for r in batches.resolve_presets(analysed).collect()}
    assert len(got) == 14
    email = got[(1, "email")]
    assert (email.target_bytes, email.needs_target, email.processing_mode) == (5 * MIB, True, "target-size")
    assert (email.image_format, email.image_long_edge) == ("webp", 1920)
    archive = got[(2, "archive")]
    assert (archive.target_bytes, archive.needs_target, archive.image_encoding) == (None, False, "lossless")


def test_untargeted_estimate(spark):
    files = spark.createDataFrame([(1, 1, "image", 1000, None, 10)], "batch_id int, file_id int, kind string, size_bytes bigint, duration_s double, height int")
    r = batches.estimate_batches(files, target_ratio=None, processing_mode="strict-lossless").first()
    assert (r.output_bytes, r.saved_bytes) == (960, 40)
    r = batches.estimate_batches(files, target_ratio=None, quality=95).first()
    assert r.output_bytes == 780


def test_fixed_ladders_are_ordered():
    assert list(dims.AUDIO_LADDER_KBPS) == sorted(dims.AUDIO_LADDER_KBPS, reverse=True)
    assert list(dims.HEIGHT_LADDER) == sorted(dims.HEIGHT_LADDER, reverse=True)
