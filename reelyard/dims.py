"""Ladders, limits, presets, formats, codes and status rules.

Everything in this module must equal the values the queries are checked against.
Values that rows are matched to are offered as literal arrays, so that a ladder or a
catalog is expanded with ``explode`` and never needs a cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MB = 1024 * 1024

# --- fixed values: intake limits -------------------------------------------------
MAX_IMAGE_BYTES = 25 * MB
MAX_VIDEO_BYTES = 250 * MB
MAX_AUDIO_BYTES = 100 * MB
MAX_SVG_BYTES = 2 * MB
MAX_IMAGE_EDGE = 16_384
MAX_IMAGE_PIXELS = 40_000_000
MAX_ANIMATION_FRAMES = 120
MAX_ANIMATION_PIXELS = 80_000_000
MAX_DURATION_S = 30 * 60
MAX_VIDEO_WIDTH = 7_680
MAX_VIDEO_HEIGHT = 4_320
MAX_FILES_PER_BATCH = 10
MAX_UPLOAD_BYTES = 250 * MB
EXECUTABLE_MIME = "(?i)x-msdownload|x-executable|x-dosexec"
MAX_EVENT_HISTORY = 400
MAX_LOG_LINES = 80
MAX_HISTORY = 60
RETENTION_CHOICES_MIN = (10, 30, 60)
DEFAULT_RETENTION_MIN = 30
FAILED_RETENTION_MIN = 10

# --- fixed values: target-size planning ------------------------------------------
AUDIO_LADDER_KBPS = (320, 256, 192, 128, 96, 64)
HEIGHT_LADDER = (2160, 1440, 1080, 720, 480)
MIN_VIDEO_KBPS = 180
SAFETY_MARGIN = 0.03
CONTAINER_OVERHEAD = 0.015
MAX_RATIO = 0.25
IMAGE_TOLERANCE = 0.02
SAMPLE_SECONDS = 3.0
CODEC_EFFICIENCY = {"av1": 0.48, "h265": 0.62, "h264": 1.0}
HEIGHT_BASE_KBPS = ((2160, 12_000), (1440, 7_000), (1080, 4_000), (720, 2_000))
LOWEST_BASE_KBPS = 900
QUALITY_FLOOR = {"jpeg": 60, "webp": 55, "avif": 45}
# preset id, target bytes, target ratio
TARGET_PRESETS = (
    ("email", 10 * MB, None),
    ("social", 50 * MB, None),
    ("website", 5 * MB, None),
    ("smartphone", 100 * MB, None),
    ("cloud", None, 0.75),
    ("half", None, 0.5),
    ("under-100mb", 100 * MB, None),
    ("custom", 25 * MB, None),
)
TARGET_UNITS = ("KB", "MB", "GB")
TARGET_AUDIO_MODES = ("auto", "320", "256", "192", "128", "96", "64", "remove")
TARGET_SPEEDS = ("fast", "balanced", "maximum-compression")

# --- fixed values: use-case presets ----------------------------------------------
# id, low %, high %, s per MB, photo format, transparent format, encoding, long edge,
# image MB, many-images MB, media MB, processing mode, speed
USE_CASE_PRESETS = (
    ("web", 45, 75, 0.75, "webp", "webp", "lossy", 2560, 5, None, None, "reduce-size", "balanced"),
    ("email", 55, 82, 0.65, "jpeg", "webp", "lossy", 1920, 5, 15, 20, "target-size", "fast"),
    ("social", 45, 72, 0.7, "jpeg", "png", "lossy", 2048, None, None, 50, "reduce-size", "balanced"),
    ("smartphone", 35, 65, 0.65, "jpeg", "png", "lossy", 2560, None, None, 100, "reduce-size", "fast"),
    ("print", 8, 32, 0.9, "jpeg", "png", "lossy", None, None, None, None,
     "high-quality-optimization", "maximum-compression"),
    ("archive", 5, 28, 1.15, "tiff", "png", "lossless", None, None, None, None,
     "archive", "maximum-compression"),
    ("presentation", 45, 70, 0.6, "jpeg", "png", "lossy", 1920, None, None, 30, "reduce-size", "fast"),
)
USE_CASE_PRESET_FIELDS = (
    ("preset_id", "string"), ("low_percent", "int"), ("high_percent", "int"),
    ("seconds_per_mb", "double"), ("photo_format", "string"), ("transparent_format", "string"),
    ("image_encoding", "string"), ("max_long_edge", "int"), ("image_mb", "int"),
    ("many_images_mb", "int"), ("media_mb", "int"), ("preset_mode", "string"),
    ("speed_preset", "string"),
)

# --- fixed values: processing modes and option enums -----------------------------
STRICT_LOSSLESS_MODES = ("lossless", "strict-lossless")
PROCESSING_MODES = (
    "reduce-size", "improve-quality", "improve-and-reduce", "convert-only", "metadata-only",
    "lossless", "strict-lossless", "high-quality-optimization", "size-priority", "archive",
    "target-size",
)
VIDEO_RESOLUTIONS = ("original", "2160", "1440", "1080", "720", "480", "custom")
VIDEO_CODECS = ("h264", "h265", "vp9", "av1")
QUALITIES = ("high", "balanced", "small")
VIDEO_AUDIO_OPTIONS = (
    "copy", "aac128", "aac96", "opus128", "opus96", "vorbis128", "flac", "pcm",
)
VIDEO_CONTAINERS = ("source", "mp4", "webm", "mkv", "mov")
SOFTWARE_ENCODERS = {
    "h264": "libx264", "h265": "libx265", "vp9": "libvpx-vp9", "av1": "libaom-av1",
}

# --- fixed values: quality search ------------------------------------------------
VMAF_THRESHOLD = 95.0
FRAME_THRESHOLD = 80.0
CRF_LADDER = (
    ("av1", 18), ("av1", 22), ("av1", 26), ("av1", 30),
    ("h265", 18), ("h265", 21), ("h265", 24), ("h265", 27),
    ("h264", 16), ("h264", 18), ("h264", 20),
)
CODEC_LABELS = {"av1": "AV1", "h265": "H.265", "h264": "H.264 高品質"}
OPTIMIZATION_MODES = ("strict-lossless", "high-quality-optimization", "size-priority", "archive")
SEARCH_PRESETS = ("medium", "slow", "slower")
ENCODER_MISSING = "エンコーダーをこのFFmpegで利用できません。"

# --- fixed values: output formats ------------------------------------------------
# value, category, video codecs, audio codecs, muxers, encoders, transparency, lossless
OUTPUT_FORMATS = (
    ("jpeg", "image", (), (), (), (), False, False),
    ("png", "image", (), (), (), (), True, True),
    ("webp", "image", (), (), (), (), True, True),
    ("avif", "image", (), (), (), (), True, True),
    ("tiff", "image", (), (), (), (), True, True),
    ("gif", "image", (), (), (), (), True, False),
    ("mp4", "video", ("h264", "h265", "av1"), ("aac",), ("mp4",), (), None, None),
    ("webm", "video", ("vp9", "av1"), ("opus", "vorbis"), ("webm",), (), None, None),
    ("mkv", "video", ("h264", "h265", "vp9", "av1"), ("aac", "opus", "flac"), ("matroska",), (), None, None),
    ("mov", "video", ("h264", "h265"), ("aac", "pcm"), ("mov",), (), None, None),
    ("mp3", "audio", (), (), ("mp3",), ("libmp3lame",), None, None),
    ("m4a", "audio", (), (), ("ipod", "mp4"), ("aac",), None, None),
    ("aac", "audio", (), (), ("adts", "aac"), ("aac",), None, None),
    ("opus", "audio", (), (), ("opus", "ogg"), ("libopus",), None, None),
    ("ogg", "audio", (), (), ("ogg",), ("libvorbis",), None, None),
    ("wav", "audio", (), (), ("wav",), ("pcm_s16le",), None, True),
    ("flac", "audio", (), (), ("flac",), ("flac",), None, True),
)
# Capability groups an output needs: every group must be met by any of its names.
OUTPUT_REQUIREMENTS = (
    ("image", "png", (("image_output", ("png",)),)),
    ("image", "jpeg", (("image_output", ("jpeg",)),)),
    ("image", "webp", (("image_output", ("webp",)),)),
    ("image", "avif", (("image_output", ("heif",)),)),
    ("image", "tiff", (("image_output", ("tiff",)),)),
    ("image", "gif", (("image_output", ("gif",)),)),
    ("video", "mp4", (("muxer", ("mp4",)), ("encoder", ("libx264", "libx265")))),
    ("video", "webm", (("muxer", ("webm",)), ("encoder", ("libvpx-vp9", "libaom-av1")))),
    ("video", "mkv", (("muxer", ("matroska",)), ("encoder", ("libx264", "libx265")))),
    ("video", "mov", (("muxer", ("mov",)), ("encoder", ("libx264", "libx265")))),
    ("audio", "mp3", (("muxer", ("mp3",)), ("encoder", ("libmp3lame",)))),
    ("audio", "m4a", (("muxer", ("ipod", "mp4")), ("encoder", ("aac",)))),
    ("audio", "aac", (("muxer", ("adts", "aac")), ("encoder", ("aac",)))),
    ("audio", "opus", (("muxer", ("opus", "ogg")), ("encoder", ("libopus",)))),
    ("audio", "ogg", (("muxer", ("ogg",)), ("encoder", ("libvorbis",)))),
    ("audio", "flac", (("muxer", ("flac",)), ("encoder", ("flac",)))),
    ("audio", "wav", (("muxer", ("wav",)), ("encoder", ("pcm_s16le",)))),
)
# Container names a probe may report for a requested output.
PROBED_FORMAT_NAMES = (
    ("video", "mp4", ("mov", "mp4", "m4a", "3gp", "3g2", "mj2")),
    ("video", "mov", ("mov", "mp4", "m4a", "3gp", "3g2", "mj2")),
    ("video", "webm", ("matroska", "webm")),
    ("video", "mkv", ("matroska", "webm")),
    ("audio", "mp3", ("mp3",)),
    ("audio", "m4a", ("mov", "mp4", "m4a", "3gp", "3g2", "mj2")),
    ("audio", "aac", ("aac",)),
    ("audio", "opus", ("ogg", "opus")),
    ("audio", "ogg", ("ogg",)),
    ("audio", "wav", ("wav",)),
    ("audio", "flac", ("flac",)),
)
# Stream codecs a container takes without re-encoding; mkv takes all.
COPYABLE_VIDEO = {
    "webm": ("vp8", "vp9", "av1"), "mp4": ("h264", "hevc", "h265", "av1"),
    "mov": ("h264", "hevc", "h265"),
}
COPYABLE_AUDIO = {"webm": ("opus", "vorbis"), "mp4": ("aac",), "mov": ("aac",)}

# --- fixed values: hardware encoders, most preferred first -----------------------
HARDWARE_PREFERENCE = (
    ("h264", "h264_nvenc", 1), ("h264", "h264_qsv", 2), ("h264", "h264_amf", 3),
    ("h264", "h264_videotoolbox", 4), ("h264", "h264_vaapi", 5),
    ("h265", "hevc_nvenc", 1), ("h265", "hevc_qsv", 2), ("h265", "hevc_amf", 3),
    ("h265", "hevc_videotoolbox", 4), ("h265", "hevc_vaapi", 5),
    ("av1", "av1_nvenc", 1), ("av1", "av1_qsv", 2), ("av1", "av1_amf", 3),
)
VENDOR_SUFFIX = (
    ("_nvenc", "nvidia"), ("_qsv", "intel"), ("_amf", "amd"), ("_vaapi", "vaapi"),
    ("_videotoolbox", "apple"),
)

# --- fixed values: kinds by file extension ---------------------------------------
KIND_EXTENSIONS = {
    "image": ("jpg", "jpeg", "png", "webp", "avif", "gif", "tif", "tiff"),
    "video": ("mp4", "mov", "mkv", "webm", "avi", "m4v"),
    "audio": ("mp3", "m4a", "aac", "wav", "flac", "ogg", "opus"),
}

# --- fixed values: metadata tags -------------------------------------------------
STRUCTURAL_TAGS = (
    "ImageWidth", "ImageHeight", "BitDepth", "ColorType", "Compression", "Filter", "Interlace",
    "JFIFVersion", "ResolutionUnit", "XResolution", "YResolution", "ComponentsConfiguration",
)
MAX_REPORTED_TAGS = 24
TAG_GROUP_PATTERNS = (
    ("GPS", "(?i)gps|latitude|longitude|altitude"),
    ("XMP", "(?i)xmp|creator|rights|rating|label"),
    ("IPTC", "(?i)iptc|headline|caption|byline|keywords"),
)

# --- fixed values: statuses ------------------------------------------------------
TERMINAL_STATUSES = ("completed", "failed", "cancelled")
WAITING_STATUSES = ("pending", "queued")
COARSE_STATUS = {
    "completed": "complete", "failed": "error", "cancelled": "cancelled", "pending": "queued",
    "queued": "queued", "validating-settings": "queued", "creating-job": "queued",
    "uploading": "queued", "complete": "complete", "error": "error",
}
ALLOWED_TRANSITIONS = {
    "validating-settings": ("creating-job", "failed", "cancelled"),
    "creating-job": ("uploading", "queued", "failed", "cancelled"),
    "uploading": ("analyzing-media", "queued", "failed", "cancelled"),
    "analyzing-media": ("estimating-output", "queued", "processing", "enhancing", "encoding",
                        "failed", "cancelled"),
    "estimating-output": ("queued", "processing", "encoding", "failed", "cancelled"),
    "queued": ("analyzing-media", "processing", "enhancing", "encoding", "failed", "cancelled"),
    "pending": ("analyzing", "processing", "cancelled", "failed"),
    "analyzing": ("processing", "enhancing", "encoding", "failed", "cancelled"),
    "processing": ("enhancing", "encoding", "finalizing", "failed", "cancelled"),
    "enhancing": ("encoding", "finalizing", "failed", "cancelled"),
    "encoding": ("finalizing", "failed", "cancelled"),
    "finalizing": ("completed", "failed", "cancelled"),
    "completed": (),
    "failed": ("pending", "analyzing", "processing"),
    "cancelled": ("pending", "analyzing", "processing"),
}

# --- fixed values: stage labels and stage-text patterns --------------------------
STAGE_LABELS = {
    "image": ("ファイルを確認", "メタデータを解析", "画像を変換", "画像を最適化",
              "出力ファイルを生成", "ダウンロード準備"),
    "video": ("ファイルを確認", "ffprobeで動画情報を解析", "メタデータを確認", "動画をデコード",
              "解像度を変更", "動画をエンコード", "音声を結合", "出力ファイルを生成",
              "ダウンロード準備"),
    "audio": ("ファイルを確認", "ffprobeで音声情報を解析", "メタデータを確認", "音声をデコード",
              "音声をエンコード", "出力ファイルを生成", "ダウンロード準備"),
    "ai-image": ("ファイルを解析", "AIモデルを読み込み", "AI高画質化", "画像を最適化",
                 "出力ファイルを生成", "ダウンロード準備"),
    "ai-video": ("ファイルを解析", "フレームを抽出", "AIモデルを読み込み", "AI高画質化",
                 "動画を再構築", "音声を結合", "出力ファイルを生成", "ダウンロード準備"),
}
STAGE_PATTERNS = (
    "ファイル|設定|確認中",
    "ffprobe|解析",
    "メタデータ",
    "デコード|抽出|分解",
    "AIモデル|解像度|変換",
    "エンコード|FFmpeg|高画質|最適化",
    "音声|結合",
    "出力|生成|再構築|検証",
    "ダウンロード|プレビュー|完了",
)
STATUS_PATTERNS = (
    ("enhancing", "AI|高画質|補正"),
    ("analyzing", "解析|ffprobe|確認|検出"),
    ("encoding", "エンコード|FFmpeg|変換|圧縮|再構築"),
    ("finalizing", "出力|検証|プレビュー|ダウンロード|完了"),
)

# --- fixed values: status of each error code --------------------------------------
_CODES_BY_STATUS = {
    400: (
        "AUDIO_ENHANCEMENT_UNSUPPORTED EMPTY_FILE FILE_REQUIRED INVALID_AI_OPTIONS INVALID_AUDIO_OPTIONS "
        "INVALID_BITRATE INVALID_ENCODING INVALID_ENHANCEMENTS INVALID_FILE INVALID_IMAGE_RESOLUTION "
        "INVALID_JOB_ID INVALID_JPEG_BACKGROUND INVALID_LOSSLESS_OPTIONS INVALID_OPTIMIZATION_MODE "
        "INVALID_OUTPUT_FORMAT INVALID_PROCESSING_MODE INVALID_QUALITY INVALID_QUALITY_SEARCH "
        "INVALID_SETTINGS INVALID_SPEED_PRESET INVALID_STREAM_SELECTION INVALID_TARGET_SIZE "
        "INVALID_TARGET_SIZE_OPTIONS INVALID_VIDEO_CODEC INVALID_VIDEO_OPTIONS JPEG_BACKGROUND_REQUIRED "
        "LOSSLESS_AUDIO_OUTPUT_REQUIRED LOSSLESS_OUTPUT_REQUIRED LOSSLESS_SETTINGS_CONFLICT "
        "TARGET_SIZE_REQUIRED UPLOAD_ID_REQUIRED UPSCALE_NOT_ALLOWED"
    ),
    404: (
        "FILE_EXPIRED NOT_FOUND PREVIEW_NOT_FOUND RESULT_NOT_READY UPLOAD_EXPIRED"
    ),
    408: (
        "AI_TIMEOUT AI_VIDEO_TIMEOUT AUDIO_TIMEOUT DECODE_TIMEOUT MEDIA_PROBE_TIMEOUT PREVIEW_TIMEOUT "
        "PROCESSING_TIMEOUT PROCESS_TIMEOUT TARGET_SIZE_TIMEOUT VIDEO_OPTIMIZATION_TIMEOUT"
    ),
    413: (
        "AI_IMAGE_TOO_LARGE AI_OUTPUT_TOO_LARGE AI_VIDEO_OUTPUT_TOO_LARGE AI_VIDEO_RESOLUTION_TOO_LARGE "
        "AI_VIDEO_TOO_LARGE AI_VIDEO_TOO_LONG ANIMATION_TOO_LARGE FILE_TOO_LARGE "
        "IMAGE_DIMENSIONS_TOO_LARGE MEDIA_DURATION_TOO_LONG SVG_TOO_LARGE VIDEO_DIMENSIONS_TOO_LARGE"
    ),
    415: (
        "AUDIO_REQUIRED DECODER_UNAVAILABLE EXECUTABLE_REJECTED IMAGE_REQUIRED TYPE_MISMATCH UNSAFE_SVG "
        "UNSUPPORTED_MEDIA UNSUPPORTED_TYPE VIDEO_REQUIRED"
    ),
    422: (
        "AI_ANIMATION_UNSUPPORTED AI_VIDEO_FFMPEG_FAILED AI_WORKER_EXITED ANIMATED_OUTPUT_UNSUPPORTED "
        "AUDIO_COPY_UNSUPPORTED AUDIO_ENCODER_UNAVAILABLE AUDIO_OUTPUT_INVALID AUDIO_OUTPUT_UNAVAILABLE "
        "AUDIO_PROCESS_FAILED CORRUPTED_MEDIA EMPTY_OUTPUT FFMPEG_EXECUTION_FAILED "
        "IMAGE_OUTPUT_UNAVAILABLE IMAGE_PROCESS_FAILED INCOMPATIBLE_AUDIO_OUTPUT INCOMPATIBLE_STREAM_COPY "
        "INCOMPATIBLE_VIDEO_OUTPUT INVALID_SAMPLE_DATA LOSSLESS_IMAGE_FORMAT_UNSUPPORTED "
        "MEDIA_INFO_INCOMPLETE MEDIA_PROBE_FAILED MEDIA_PROBE_OUTPUT_TOO_LARGE METADATA_ONLY_UNSUPPORTED "
        "OUTPUT_CODEC_MISMATCH OUTPUT_FORMAT_MISMATCH OUTPUT_VALIDATION_FAILED REAL_ESRGAN_FAILED "
        "STREAM_REQUIRED TARGET_OUTPUT_INVALID TARGET_SIZE_ANIMATION_UNSUPPORTED TARGET_SIZE_PROBE_FAILED "
        "TARGET_SIZE_PROCESS_FAILED TARGET_SIZE_UNREACHABLE VIDEO_ENCODER_UNAVAILABLE "
        "VIDEO_INFO_INCOMPLETE VIDEO_OPTIMIZATION_FAILED VIDEO_OPTIMIZATION_INFO_INCOMPLETE "
        "VIDEO_OPTIMIZATION_PROBE_FAILED VIDEO_OUTPUT_UNAVAILABLE VIDEO_PREVIEW_FAILED "
        "VIDEO_PROCESS_FAILED VMAF_RESULT_INVALID ZERO_DURATION"
    ),
    499: (
        "CANCELLED"
    ),
    500: (
        "FFPROBE_NOT_FOUND INTERNAL_ERROR INVALID_OUTPUT_PATH"
    ),
    503: (
        "AAC_UNAVAILABLE AI_WORKER_FAILED ENCODER_UNAVAILABLE FFMPEG_NOT_FOUND FFMPEG_UNAVAILABLE "
        "FFPROBE_UNAVAILABLE GFPGAN_UNAVAILABLE REAL_ESRGAN_UNAVAILABLE TARGET_VIDEO_ENCODER_UNAVAILABLE "
        "TARGET_VIDEO_OUTPUT_UNAVAILABLE"
    ),
    507: (
        "INSUFFICIENT_STORAGE"
    ),
}
ERROR_STATUS = {code: status for status, codes in _CODES_BY_STATUS.items() for code in codes.split()}
RETRYABLE_ERRORS = ("PROCESSING_TIMEOUT", "INSUFFICIENT_STORAGE")
DEFAULT_ERROR_STATUS = 400

# --- fixed values: containers of copies ------------------------------------------
# probe formats, codec, end of the file name, container
SOURCE_CONTAINERS = (
    (("webm",), "", "", "webm"),
    (("matroska",), "", ".webm", "webm"),
    (("matroska",), "", "", "mkv"),
    (("mov", "mp4"), "", ".mov", "mov"),
    (("mov", "mp4"), "", "", "mp4"),
)
AUDIO_COPY_FORMATS = (
    (("mp3",), "mp3", "", "mp3"),
    (("mov", "mp4", "m4a"), "aac", "", "m4a"),
    (("aac",), "aac", "", "aac"),
    (("opus", "ogg"), "opus", ".ogg", "ogg"),
    (("opus", "ogg"), "opus", "", "opus"),
    (("ogg",), "vorbis", "", "ogg"),
    (("flac",), "flac", "", "flac"),
    (("wav",), "pcm_", "", "wav"),
)
STRICT_EXTENSIONS = ("mp4", "mov", "mkv", "webm", "avi", "ts", "m2ts", "ogv")
STRICT_CONTAINERS = (
    (("webm",), "", "", "webm"),
    (("matroska",), "", "", "mkv"),
    (("mov", "mp4"), "", "", "mp4"),
    (("avi",), "", "", "avi"),
    (("mpegts",), "", "", "ts"),
    (("ogg",), "", "", "ogv"),
)
# --- fixed values: units of sizes --------------------------------------------------
SIZE_UNITS = {"KB": 1024, "MB": 1024**2, "GB": 1024**3}

# --- fixed values: log allowlist -------------------------------------------------
LOG_LABEL_FIELDS = ("encoder", "processingMode")
LOG_METRIC_FIELDS = (
    "inputDurationSeconds", "decodingMilliseconds", "filteringMilliseconds",
    "encodingMilliseconds", "outputValidationMilliseconds", "totalMilliseconds",
    "averageEncodingFps", "averageSpeedRatio",
)


def int_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def struct_array(rows, fields) -> Column:
    """A constant array of structs, ready for ``inline`` or ``explode``."""
    return F.array(
        *[
            F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(row, fields)])
            for row in rows
        ]
    )


def lookup(key: Column, pairs: dict, default: Column | None = None) -> Column:
    """Constant map lookup by a ``CASE`` expression."""
    expr = None
    for k, v in pairs.items():
        expr = F.when(key == k, F.lit(v)) if expr is None else expr.when(key == k, F.lit(v))
    return expr if default is None else expr.otherwise(default)


def frame(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A fixed catalog as a DataFrame; at most a few hundred rows, safe to broadcast."""
    return F.broadcast(spark.createDataFrame(list(rows), schema))


def format_codecs(spark: SparkSession) -> DataFrame:
    """Allowed (container, stream type, codec) triples of the video containers."""
    rows = [
        (value, stream, codec)
        for value, category, video, audio, *_ in OUTPUT_FORMATS
        if category == "video"
        for stream, codecs in (("video", video), ("audio", audio))
        for codec in codecs
    ]
    return frame(spark, rows, "container string, stream string, codec string")


def transition_edges(spark: SparkSession) -> DataFrame:
    rows = [(a, b) for a, targets in ALLOWED_TRANSITIONS.items() for b in targets]
    return frame(spark, rows, "from_status string, to_status string")


def output_requirements(spark: SparkSession) -> DataFrame:
    rows = [
        (category, output, position, section, name)
        for category, output, groups in OUTPUT_REQUIREMENTS
        for position, (section, names) in enumerate(groups)
        for name in names
    ]
    return frame(
        spark, rows, "category string, output string, need int, section string, name string"
    )
