"""Readers, parsers, settings, verification and retention goldens."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from reelyard.functions import names
from reelyard.functions.parsing import clock_seconds, frame_rate, trailing_sequence, with_suffix
from reelyard.operators import benchlog, fleet, intake, logs, naming, retention, settings, verification
from reelyard.sources import files, heads, probes, sinks


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_parsing(spark):
    assert one(spark, clock_seconds(F.lit("01:02:03.500")), clock_seconds(F.lit("00:60:00")), clock_seconds(F.lit("not-a-time"))) == (3723.5, None, None)
    assert one(spark, frame_rate(F.lit("30000/1001")), frame_rate(F.lit("0/0")), frame_rate(F.lit("25")), frame_rate(F.lit("x/1"))) == (29.97, None, 25.0, None)
    assert one(spark, with_suffix(F.lit(" 1342.5kbits/s"), "kbits/s"), with_suffix(F.lit("1.8x"), "x"), with_suffix(F.lit("N/A"), "x")) == (1342.5, 1.8, None)
    assert one(spark, trailing_sequence(F.lit("job:12")), trailing_sequence(F.lit("7")), trailing_sequence(F.lit("a7")), trailing_sequence(F.lit(None).cast("string"))) == (12, 7, 0, 0)


def test_target_probe(spark):
    streams = [{"codec_type": "audio", "codec_name": n, "bit_rate": str(b)} for n, b in (("flac", 700_400), ("ac3", 384_000))]
    streams.insert(1, {"codec_type": "video", "codec_name": "vp9", "bit_rate": "1250499", "width": 640, "height": 360, "avg_frame_rate": "24000/1001"})
    good = {"format": {"format_name": "webm", "duration": "7.25", "size": "1234567", "bit_rate": "2400600"}, "streams": streams}
    raw = spark.createDataFrame([(4, '{"format": {"duration": "-1"}}'), (5, "no json"), (6, json.dumps(good))], "file_id int, raw string")
    got = {r.file_id: r.asDict() for r in probes.parse_target_probes(raw).collect()}
    assert got[4]["reject_reason"] == "ZERO_DURATION" and got[5]["reject_reason"] == "TARGET_SIZE_PROBE_FAILED"
    want = {
        "reject_reason": None, "kind": "video", "duration_s": 7.25, "size_bytes": 1_234_567, "video_kbps": 1250, "audio_kbps": 1084,
        "audio_track_count": 2, "fps": 23.976, "width": 640, "height": 360, "audio_codecs": ["flac", "ac3"],
    }
    assert {k: got[6][k] for k in want} == want


def test_inspection_probe(spark):
    doc = {
        "streams": [
            {"index": 0, "codec_type": "video", "codec_name": "mjpeg", "disposition": {"attached_pic": 1}},
            {"index": 1, "codec_type": "video", "codec_name": "hevc", "width": 3840, "height": 2160, "duration": "12.5", "pix_fmt": "yuv420p10le",
             "side_data_list": [{}, {"rotation": -90}], "r_frame_rate": "25/1", "avg_frame_rate": "0/0"},
            {"index": 2, "codec_type": "weird"},
        ],
        "chapters": [{"id": 1}], "format": {"format_name": "mov,mp4", "tags": {"title": "x"}},
    }
    raw = spark.createDataFrame([(1, json.dumps(doc)), (2, '{"streams": [], "format": {"duration": "3"}}')], "file_id int, raw string")
    got = {r.file_id: r for r in probes.parse_probes(raw).collect()}
    v = got[1].video
    assert (v.codec, v.width, v.fps, v.rotation, v.hdr) == ("hevc", 3840, 25.0, -90.0, True)
    assert (got[1].duration_s, got[1].chapter_count, got[1].audio, got[1].format_tags) == (12.5, 1, None, {"title": "x"})
    assert [s.type for s in got[1].streams] == ["video", "video", "unknown"]
    assert got[2].reject_reason == "MEDIA_INFO_INCOMPLETE"


@pytest.mark.parametrize(
    "original, ext, want",
    [("holiday.heic", "webp", "holiday_comp.webp"), ("a.b.c.gif", ".JPG", "a.b.c_comp.jpg"), ("scan", "avif", "scan_comp.avif"),
     ("écran.v2.png", "png", "écran.v2_comp.png"), ("w|x?y*.bmp", "webp", "w_x_y__comp.webp"),
     ("dots.. .tif", "png", "dots_comp.png"), (".cr2", "jpg", "compressed_file_comp.jpg"), ("LPT3.raw", "", "_LPT3_comp.bin")],
)
def test_compressed_names(spark, original, ext, want):
    assert one(spark, names.compressed_name(F.lit(original), F.lit(ext))) == (want,)


def test_unique_names(spark):
    rows = [("b", 1, "photo.jpg", "webp"), ("b", 2, "PHOTO.png", "webp"), ("b", 3, "photo.tiff", "webp"), ("c", 1, "photo.jpg", "webp"),
            ("b", 4, "cafe\u0301.jpg", "png"), ("b", 5, "caf\u00e9.gif", "png"), ("b", 6, "photo_comp_2.jpg", "webp")]
    df = spark.createDataFrame(rows, "batch_id string, ord bigint, original_name string, output_ext string")
    got = {(r.batch_id, r.ord): r.download_name for r in naming.unique_names(df, size=2).collect()}
    assert got == {
        ("b", 1): "photo_comp.webp", ("b", 2): "PHOTO_comp_2.webp", ("b", 3): "photo_comp_3.webp", ("c", 1): "photo_comp.webp",
        ("b", 4): "caf\u00e9_comp.png", ("b", 5): "caf\u00e9_comp_2.png", ("b", 6): "photo_comp_2_comp.webp",
    }


def test_attachment_header(spark):
    (value,) = one(spark, names.attachment_header(F.lit("資料 (1)*_comp.webp\r\nX-Test: yes")))
    assert value.startswith('attachment; filename="') and "\r" not in value and "\n" not in value
    assert value.endswith("filename*=UTF-8''%E8%B3%87%E6%96%99%20%281%29__comp.webp__X-Test_%20yes")


def test_progress_log_blocks(spark, tmp_path):
    first = ["frame=4", "out_time=00:01:00.250", "speed=0.5x", "progress=continue\r", "fps=12\r", "out_time_us=90000000\r", "progress=end\r", "frame=9"]
    (tmp_path / "render-1.log").write_bytes("\n".join(first).encode())
    (tmp_path / "render-2.log").write_text("progress=end\nframe=77\nprogress=continue\n")
    lines = files.read_progress_log(spark, str(tmp_path))
    blocks = logs.assemble_blocks(lines, chunk=F.col("chunk"))
    got = {(r.job_id, r.block): (r.frame, r.fps, r.out_time_s, r.speed, r.state) for r in blocks.collect()}
    assert got == {
        ("render-1", 0): (4.0, None, 60.25, 0.5, "continue"), ("render-1", 1): (None, 12.0, 90.0, None, "end"),
        ("render-1", 2): (9.0, None, None, None, None), ("render-2", 0): (None, None, None, None, "end"),
        ("render-2", 1): (77.0, None, None, None, "continue"),
    }
    jobs = spark.createDataFrame([("render-1", 120.5, 18)], "job_id string, total_duration_s double, total_frames int")
    progress = {(r.job_id, r.block): r.progress for r in logs.progress_from_metrics(blocks, jobs).collect()}
    assert progress == {("render-1", 0): 50.0, ("render-1", 1): 74.7, ("render-1", 2): 50.0, ("render-2", 0): 0.0, ("render-2", 1): 0.0}


def test_blocks_across_chunks(spark):
    rows = [(1, n, f"frame={n}" if n % 3 else "progress=continue") for n in range(1, 61)]
    df = spark.createDataFrame(rows, "job_id int, line_no bigint, line string")
    got = sorted((r.block, r.frame) for r in logs.assemble_blocks(df, size=4).collect())
    assert got == [(b, 3.0 * b + 2) for b in range(20)]


def test_benchmark_log_reader(spark, tmp_path):
    lines = [
        {"benchmark": "before", "type": "benchmark-stage", "caseId": "large", "stage": "encode", "elapsedMs": 8511.694, "status": "ok"},
        {"benchmark": "after", "type": "benchmark-stage", "caseId": "large", "stage": "encode", "elapsedMs": 5455.794, "status": "ok"},
        {"benchmark": "before", "type": "benchmark-quality", "caseId": "large", "metric": "psnr", "value": 42.922},
        {"benchmark": "before", "type": "benchmark-quality", "caseId": "png", "metric": "pixel_equal", "value": False},
        {"benchmark": "before", "type": "benchmark-quality", "caseId": "png", "metric": "psnr", "value": "infinite"},
    ]
    (tmp_path / "log.jsonl").write_text("\n".join(json.dumps(x) for x in lines))
    log = files.read_benchmark_log(spark, str(tmp_path))
    assert {r.value for r in log.filter("type = 'benchmark-quality'").collect()} == {"42.922", "false", "infinite"}
    micro = log.filter("type = 'benchmark-stage'").withColumn("elapsed_us", F.round(F.col("elapsed_ms") * 1000).cast("bigint"))
    r = benchlog.compare_runs(micro, "before", "after").first()
    assert (r.first_ms, r.second_ms, r.saved_ms, r.saved_percent) == (8511.694, 5455.794, 3055.9, 35.9)
    m = benchlog.benchmark_matrix(micro, ["before", "after"]).first()
    assert (m.before_ms, m.after_ms) == (8511.694, 5455.794)


def test_exact_percentile(spark):
    rows = [("a", v, False) for v in range(1, 101)] + [("b", 7, True), ("b", None, False)]
    df = spark.createDataFrame(rows, "stage string, elapsed_us bigint, failed boolean")
    got = {r.stage: (r.rows, r.errors, r.p95_ms) for r in benchlog.stage_summary(df, bucket_us=10).collect()}
    assert got == {"a": (100, 0, 0.095), "b": (2, 1, 0.007)}


def test_intake_scan_of_files(spark, tmp_path):
    (tmp_path / "a.exe").write_bytes(b"MZ\x90\x00")
    (tmp_path / "b.sh").write_bytes(b"#!/bin/sh")
    (tmp_path / "c.elf").write_bytes(b"\x7fELF\x02")
    (tmp_path / "d.macho").write_bytes(b"\xca\xfe\xba\xbe")
    (tmp_path / "e.jpg").write_bytes(b"\xff\xd8\xff\xe0")
    (tmp_path / "f.empty").write_bytes(b"")
    clean, held = files.quarantine(files.scan_intake(spark, str(tmp_path)))
    assert {(r.path.rsplit("/", 1)[1], r.size_bytes) for r in clean.collect()} == {("e.jpg", 4), ("f.empty", 0)}
    assert held.count() == 4
    assert all(r.path.startswith("file:///") for r in held.collect())


def test_folders_are_walked_and_big_files_cost_their_head(spark, tmp_path):
    deep = tmp_path / "a" / "b" / "é c"
    deep.mkdir(parents=True)
    (tmp_path / "empty").mkdir()
    (deep / ".hidden").write_bytes(b"MZ")
    for i in range(40):
        (deep / f"{i}.bin").write_bytes(bytes([i]) * i)
    with open(tmp_path / "huge.exe", "wb") as file:  # two gigabytes, without any on disk
        file.write(b"MZxx")
        file.truncate(2 << 30)
    want = {f"file://{p}": p.stat().st_size for p in tmp_path.rglob("*") if p.is_file()}
    for root in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}/"):
        assert {r.path: r.size_bytes for r in heads.list_files(spark, root).collect()} == want
    got = files.scan_intake(spark, str(tmp_path))
    assert {r.path: r.size_bytes for r in got.collect()} == want
    assert {r.path.rsplit("/", 1)[1] for r in got.filter("executable").collect()} == {".hidden", "huge.exe"}
    read = heads.with_bytes(heads.list_files(spark, str(deep)), str(deep), None).collect()
    assert {r.path.rsplit("/", 1)[1]: r.content for r in read} == {f"{i}.bin": bytes([i]) * i for i in range(40)} | {".hidden": b"MZ"}
    assert heads.list_files(spark, str(tmp_path / "empty")).collect() == []


def test_svg_scan(spark):
    docs = [(1, b"<svg><path d='M0 0'/></svg>"), (2, b"<!doctype svg>"), (3, b"<svg onload = 'x()'>"), (4, b"<a xlink:href=' HTTPS://x'>"), (5, b"<scripty>"), (6, b"<!ENTITY x>")]
    scanned = intake.scan_svg(spark.createDataFrame(docs, "id int, content binary"))
    assert {r.id for r in scanned.filter("unsafe").collect()} == {2, 3, 4, 6}


def test_job_document_reader(spark, tmp_path):
    good, other = "0123abcd-0000-0000-0000-0123456789ab", "1123abcd-0000-0000-0000-0123456789ab"
    for folder, owner, name in ((good, good, "a.mp4"), (other, good, "b.mp4"), ("not-a-job", "not-a-job", "c.mp4")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "manifest.json").write_text(json.dumps({"jobId": owner, "outputName": name}, indent=2))
    assert [r.job_id for r in files.read_job_documents(spark, str(tmp_path), "manifest").collect()] == [good]


def test_settings_audit_golden(spark):
    columns = ("batch_id int, kind string, status string, inspection_status string, upload_id string, item_format string, processing_mode string,"
               " image_format string, image_encoding string, image_quality int, jpeg_background string, video_mode string, video_resolution string,"
               " custom_height int, video_codec string, video_quality string, video_audio string, video_container string, audio_mode string,"
               " audio_format string, audio_quality string, target_enabled boolean, target_bytes bigint, target_ratio double")
    base = dict(batch_id=1, kind="video", status="queued", inspection_status="ready", upload_id="u", item_format=None, processing_mode="target-size",
                image_format="webp", image_encoding="lossy", image_quality=80, jpeg_background=None, video_mode="compress", video_resolution="custom",
                custom_height=721, video_codec="h264", video_quality="balanced", video_audio="copy", video_container="mp4", audio_mode="reduce-size",
                audio_format="mp3", audio_quality="high", target_enabled=True, target_bytes=0, target_ratio=None)
    rows = [base, dict(base, batch_id=2, custom_height=720, target_bytes=5), dict(base, batch_id=3, status="complete"),
            dict(base, batch_id=4, custom_height=720, target_bytes=5, video_container="webm")]
    names_ = [c.split()[0] for c in columns.split(", ")]
    df = spark.createDataFrame([tuple(r[n] for n in names_) for r in rows], columns)
    got = {}
    for r in settings.audit_settings(df).collect():
        got.setdefault(r.batch_id, set()).add(r.rule)
    assert got == {1: {"custom-height", "video-options", "target-options"}, 3: {"no-items"}, 4: {"webm-codec", "container-codec"}}


def test_containers(spark):
    assert one(
        spark, settings.source_container(F.lit("matroska,webm"), F.lit("a.mkv")), settings.source_container(F.lit("mov,mp4"), F.lit("a.MOV")),
        settings.audio_copy_format(F.lit("ogg"), F.lit("opus"), F.lit("x.ogg")), settings.audio_copy_format(F.lit("wav"), F.lit("pcm_s16le"), F.lit("x")),
        settings.strict_container(F.lit("mpegts"), F.lit("x")), settings.strict_container(F.lit("a"), F.lit("x.M2TS")),
        settings.copyable_audio(F.lit("pcm_s24le"), F.lit("mov")), settings.copyable_video(F.lit("vp9"), F.lit("mp4")),
    ) == ("webm", "mov", "ogg", "wav", "ts", "m2ts", True, False)


def test_structured_logs(spark, tmp_path):
    raw = [json.dumps({"jobId": "job-1", "fileId": "C:\\x", "stage": " encode ", "errorCode": "BAD_1", "elapsedMs": 5.5, "path": "/tmp/x", "encoder": "a b"}),
           json.dumps({"jobId": "../x", "elapsedMs": -1, "stage": "a/b", "averageSpeedRatio": 2})]
    df = spark.createDataFrame([(r,) for r in raw], "raw string")
    a, b = logs.allowlist_logs(df).collect()
    assert (a.jobId, a.fileId, a.stage, a.errorCode, a.elapsedMs, a.encoder) == ("job-1", None, "encode", "BAD_1", 5.5, None)
    assert (b.jobId, b.elapsedMs, b.stage, b.averageSpeedRatio) == (None, None, None, 2.0)
    sinks.write_logs(df, str(tmp_path / "out"))
    written = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert {"averageSpeedRatio": 2.0} in written and "path" not in str(written)


def test_redaction(spark):
    df = spark.createDataFrame([(1, "s", "failed at /tmp/work/job/source.bin now"), (1, "s", r"C:\a\b.mp4 and \\host\x"), (1, "s", "fine")], "job_id int, stage string, message string")
    rows = logs.redact_messages(df).collect()
    assert [r.redactions for r in rows] == [1, 2, 0]
    assert rows[0].message == "failed at [一時ファイル] now" and rows[1].message == "[内部パス] and [内部パス]"


def test_performance_golden(spark):
    samples = spark.createDataFrame([(1, 60.0, 2.0), (1, 120.0, 4.0), (1, -1.0, float("nan"))], "job_id int, fps double, speed double")
    jobs = spark.createDataFrame([(1, "x264", 4000.0, 100.0)], "job_id int, encoder string, encoding_ms double, validation_ms double")
    r = logs.performance_metrics(samples, jobs).first()
    assert (r.average_fps, r.average_speed, r.total_ms) == (90.0, 3.0, 4100.0)


def test_removal_golden(spark):
    rows = [(1, 0, "video", False, None, None, None), (1, 1, "audio", False, None, None, None), (1, 2, "audio", False, "commentary", None, None),
            (1, 3, "subtitle", False, None, "jpn", None), (1, 4, "attachment", False, None, None, "font.ttf")]
    streams = spark.createDataFrame(rows, "file_id int, idx int, type string, is_attached_picture boolean, title string, language string, filename string")
    all_on = spark.createDataFrame([(1, 9, 4, {"title": "x", "artist": "y"}, True, True, True, True, True)],
                                   "file_id int, batch_id int, chapter_count int, format_tags map<string,string>, keep_primary_audio boolean, remove_subtitles boolean,"
                                   " remove_attachments boolean, remove_chapters boolean, strip_privacy boolean")
    counts = {r.category: r["items"] for r in verification.removal_counts(streams, all_on).collect()}
    assert counts == {"audio": 1, "subtitle": 1, "attachment": 1, "chapter": 4, "metadata": 2}
    details = {(r.category, r.detail) for r in verification.removal_items(streams, all_on).collect()}
    assert ("audio", "commentary") in details and ("subtitle", "jpn") in details and ("metadata", "artist") in details


def test_stream_verification(spark):
    schema = "file_id int, hash string"
    before = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a"), (3, "# note")], schema)
    after = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (2, "a"), (2, "a"), (4, "z")], schema)
    got = {r.file_id: (r.verified, r.missing_streams, r.extra_streams) for r in verification.verify_streams(before, after).collect()}
    assert got == {1: (True, 0, 0), 2: (False, 0, 1), 4: (False, 0, 1)}


def test_output_verification(spark):
    requested = spark.createDataFrame([(1, "video", "mp4", "h265"), (2, "video", "webm", None), (3, "audio", "wav", None), (4, "audio", "ogg", None), (5, "video", "mp4", None)],
                                      "file_id int, kind string, output_format string, codec string")
    probed = spark.createDataFrame([(1, "mov,mp4", "hevc", 1), (2, "mov", "vp9", 1), (3, "wav", "pcm_s16le", 1), (4, "ogg", "opus", 1), (5, "mp4", "x", 0)],
                                   "file_id int, format_name string, probed_codec string, output_bytes bigint")
    got = {r.file_id: r.violation for r in verification.verify_outputs(requested, probed).collect()}
    assert got == {1: None, 2: "OUTPUT_FORMAT_MISMATCH", 3: None, 4: "OUTPUT_CODEC_MISMATCH", 5: "EMPTY_OUTPUT"}


def test_retention(spark):
    rows = [(1, datetime(2024, 1, 1, 11, 49), 10, False), (2, datetime(2024, 1, 1, 11, 49), 60, True), (3, datetime(2024, 1, 1, 11, 49), 60, False),
            (4, datetime(2024, 1, 1, 11, 31), 45, False), (5, datetime(2024, 1, 1, 11, 30), 45, False), (6, datetime(2024, 1, 1, 11, 0), 10, False)]
    df = spark.createDataFrame(rows, "job_id int, last_modified timestamp, retention_min int, failed boolean")
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    active = spark.createDataFrame([(6,)], "job_id int")
    assert {r.job_id for r in retention.expired_jobs(df, now, active).collect()} == {1, 2}


def test_partition_pruning_of_active_results(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1 + i, 12), "image", f"f{i}.webp") for i in range(10)]
    df = spark.createDataFrame(rows, "file_id int, created_at timestamp, kind string, download_name string")
    sinks.write_results(df, str(tmp_path / "r"), F.lit(60))
    read = spark.read.parquet(str(tmp_path / "r"))
    now = F.lit("2024-01-05 12:30:00").cast("timestamp")
    found = retention.active_results(read, now)
    assert {r.file_id for r in found.collect()} == {4, 5, 6, 7, 8, 9}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(created_date" in plan


def test_fleet(spark):
    rows = [(1, "formats", " DE matroska,webm  x"), (1, "formats", " D  mov,mp4"), (1, "formats", "  E mp4"), (1, "encoders", " V....D libx264   H.264"),
            (1, "encoders", " V..... = Video"), (1, "encoders", " V....D h264_qsv"), (1, "encoders", " V....D h264_nvenc"), (1, "filters", " TS. scale  V->V"),
            (1, "hwaccels", "Hardware acceleration methods:"), (1, "hwaccels", "cuda")]
    caps = fleet.parse_capabilities(spark.createDataFrame(rows, "host int, section string, line string"))
    got = {(r.section, r.name) for r in caps.collect()}
    assert {("muxer", "webm"), ("demuxer", "mov"), ("muxer", "mp4"), ("encoder", "libx264"), ("filter", "scale"), ("hwaccel", "cuda")} <= got
    assert ("muxer", "mov") not in got and ("encoder", "=") not in got
    from reelyard import dims

    outs = {r.output for r in fleet.supported_outputs(caps, dims.output_requirements(spark)).collect()}
    assert outs == {"mp4", "mkv"}
    pref = dims.frame(spark, dims.HARDWARE_PREFERENCE, "codec string, name string, rank int")
    assert fleet.pick_encoder(caps, pref).first().encoder == "h264_nvenc"
    assert fleet.vendors(caps).first().vendors == 2


def test_admission_reasons(spark):
    mb = 1024 * 1024
    rows = [(1, 1, "a", 5, 1, "image/png"), (1, 2, "a", 5, 1, None), (1, 3, "b", 0, 1, None), (1, 4, "c", 250 * mb, 1, None), (1, 5, "d", 250 * mb + 1, 1, None),
            (1, 6, "e", 5, 1, "application/X-DOSexec"), (1, 7, "g", None, None, None), (1, 8, "h", 1, None, ""), (1, 9, "h", 1, None, ""), (1, 10, "a", 0, 1, None),
            (1, 11, "z", 0, 1, None), (1, 12, "a", 5, 1, None), (2, 1, "a", 5, 1, None)]
    df = spark.createDataFrame(rows, "batch_id int, ord int, name string, size_bytes bigint, modified int, mime string")
    got = {(r.batch_id, r.ord): r.outcome for r in intake.admit(df).collect()}
    want = ["admitted", "duplicate", "empty", "admitted", "oversized", "executable", "empty", "admitted", "duplicate", "empty", "over-limit", "over-limit"]
    assert got == {(1, i + 1): o for i, o in enumerate(want)} | {(2, 1): "admitted"}
    assert {r.outcome for r in intake.admit(df.drop("mime").withColumn("outcome", F.lit(1))).collect()} == set(want) - {"executable"}
    assert intake.admit(df.limit(0)).collect() == []


def test_target_options_rules(spark):
    good = dict(target_enabled=True, target_preset="email", target_bytes=10, target_ratio=None, target_unit="MB", target_audio="auto", allow_resolution_change=False,
                allow_lossy_png=False, target_background=None, floor_jpeg=60, floor_webp=55, floor_avif=45, floor_height=720, floor_kbps=96, target_speed=None)
    changes = [{}, {"target_preset": "x"}, {"target_bytes": None}, {"target_ratio": 0.5}, {"target_bytes": 2**53}, {"target_bytes": None, "target_ratio": 1.0},
               {"floor_avif": 101, "floor_height": 360}, {"target_unit": None, "target_speed": "slow"}, {"target_background": "#12345g", "floor_kbps": None}]
    schema = ("id int, target_enabled boolean, target_preset string, target_bytes bigint, target_ratio double, target_unit string, target_audio string, allow_resolution_change boolean,"
              " allow_lossy_png boolean, target_background string, floor_jpeg int, floor_webp int, floor_avif int, floor_height int, floor_kbps int, target_speed string")
    df = spark.createDataFrame([(i, *(good | c).values()) for i, c in enumerate(changes)], schema)
    got = {r.id: r.broken for r in settings.audit_target_options(df).collect()}
    assert got == {0: [], 1: ["preset"], 2: ["one-target"], 3: ["one-target"], 4: ["bytes"], 5: [], 6: ["floor-avif", "floor-height"], 7: ["unit", "speed"], 8: ["background", "floor-kbps"]}
