"""Settings audit, processing routes and container flow."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims

_FORMATS = {
    category: [v for v, c, *_ in dims.OUTPUT_FORMATS if c == category]
    for category in ("image", "video", "audio")
}
HEX_COLOUR = "(?i)^#[0-9a-f]{6}$"


def _not(condition: Column) -> Column:
    """Negation that treats an unknown value as a broken rule."""
    return ~F.coalesce(condition, F.lit(False))


def _container_takes(container: Column, codec: Column) -> Column:
    ok = F.lit(False)
    for value, category, video, *_ in dims.OUTPUT_FORMATS:
        if category == "video":
            ok = ok | ((container == value) & codec.isin(*video))
    return ok


def target_rules() -> dict[str, Column]:
    """Field of the target options to the condition that breaks its rule; unknown values do.

    Columns: target_enabled, target_preset, target_bytes, target_ratio, target_unit,
    target_audio, allow_resolution_change, allow_lossy_png, target_background, floor_jpeg,
    floor_webp, floor_avif, floor_height, floor_kbps, target_speed. Bytes, ratio, background
    and speed may be null, but exactly one of bytes and ratio is given.
    """
    c = F.col
    size, ratio = c("target_bytes"), c("target_ratio")
    valid = {
        "enabled": c("target_enabled").isNotNull(),
        "preset": c("target_preset").isin(*[p for p, *_ in dims.TARGET_PRESETS]),
        "bytes": size.isNull() | ((size > 0) & (size < 2**53)),
        "ratio": ratio.isNull() | ((ratio > 0) & (ratio <= 1)),
        "one-target": size.isNotNull() != ratio.isNotNull(),
        "unit": c("target_unit").isin(*dims.TARGET_UNITS),
        "audio": c("target_audio").isin(*dims.TARGET_AUDIO_MODES),
        "resolution-change": c("allow_resolution_change").isNotNull(),
        "lossy-png": c("allow_lossy_png").isNotNull(),
        "background": c("target_background").isNull() | c("target_background").rlike(HEX_COLOUR),
        **{f"floor-{f}": c(f"floor_{f}").between(1, 100) for f in dims.QUALITY_FLOOR},
        "floor-height": c("floor_height").isin(*dims.HEIGHT_LADDER),
        "floor-kbps": c("floor_kbps").isin(*dims.AUDIO_LADDER_KBPS),
        "speed": c("target_speed").isNull() | c("target_speed").isin(*dims.TARGET_SPEEDS),
    }
    return {field: _not(ok) for field, ok in valid.items()}


def audit_target_options(options: DataFrame) -> DataFrame:
    """``options`` with ``broken``: the fields of the target options whose rule is broken, in order."""
    broken = F.array_compact(F.array(*[F.when(cond, F.lit(n)) for n, cond in target_rules().items()]))
    return options.withColumn("broken", broken)


def settings_rules(whole_target: bool = False) -> dict[str, Column]:
    """Rule name to the condition that breaks it, for one active item.

    ``whole_target``: the item has all columns of ``target_rules``, which are then all checked.
    """
    c = F.col
    kind, mode, wanted = c("kind"), c("processing_mode"), c("item_format")
    image, video, audio = kind == "image", kind == "video", kind == "audio"
    strict = mode.isin(*dims.STRICT_LOSSLESS_MODES)
    quality_free = (c("image_format") == "png") | (
        (c("image_encoding") == "lossless") & c("image_format").isin("webp", "avif", "tiff")
    )
    height = c("custom_height")
    height_ok = (height >= 144) & (height <= 4320) & (height % 2 == 0)
    video_ok = (
        c("video_mode").isin("copy", "compress")
        & c("video_resolution").isin(*dims.VIDEO_RESOLUTIONS)
        & c("video_codec").isin(*dims.VIDEO_CODECS)
        & c("video_quality").isin(*dims.QUALITIES)
        & c("video_audio").isin(*dims.VIDEO_AUDIO_OPTIONS)
        & (c("video_container").isNull() | c("video_container").isin(*dims.VIDEO_CONTAINERS))
        & (height.isNull() | height_ok)
    )
    container = F.coalesce(wanted, c("video_container"))
    audio_ok = (
        c("audio_mode").isin(*dims.PROCESSING_MODES)
        & c("audio_format").isin(*_FORMATS["audio"])
        & c("audio_quality").isin(*dims.QUALITIES)
    )
    whole = reduce(or_, target_rules().values()) if whole_target else F.lit(False)
    target_ok = (
        c("target_enabled")
        & ~whole
        & (c("target_bytes").isNotNull() != c("target_ratio").isNotNull())
        & (c("target_bytes").isNull() | (c("target_bytes") > 0))
        & (c("target_ratio").isNull() | ((c("target_ratio") > 0) & (c("target_ratio") <= 1)))
    )
    return {
        "not-inspected": _not(c("inspection_status") == "ready"),
        "unknown-kind": kind == "unknown",
        "missing-upload": (video | audio) & c("upload_id").isNull(),
        "image-format": image & _not(c("image_format").isin(*_FORMATS["image"])),
        "image-item-format": image & wanted.isNotNull() & ~wanted.isin(*_FORMATS["image"]),
        "jpeg-background": image
        & (F.coalesce(wanted, c("image_format")) == "jpeg")
        & _not(F.coalesce(c("jpeg_background"), F.lit("#ffffff")).rlike(HEX_COLOUR)),
        "image-quality": image & _not(quality_free)
        & _not((c("image_quality") >= 1) & (c("image_quality") <= 100)),
        "lossless-image": image & strict
        & ((c("image_format") == "jpeg") | (c("image_encoding") == "lossy")),
        "video-item-format": video & wanted.isNotNull() & ~wanted.isin(*_FORMATS["video"]),
        "custom-height": video & (c("video_resolution") == "custom") & _not(height_ok),
        "video-options": video & _not(video_ok),
        "webm-codec": video & (c("video_container") == "webm")
        & _not(c("video_codec").isin("vp9", "av1")),
        "container-codec": video & (c("video_mode") == "compress") & container.isNotNull()
        & (container != "source") & _not(_container_takes(container, c("video_codec"))),
        "lossless-video": video & strict
        & ((c("video_mode") != "copy") | (c("video_resolution") != "original")),
        "audio-options": audio & _not(audio_ok),
        "lossless-audio": audio & audio_ok & c("audio_mode").isin(*dims.STRICT_LOSSLESS_MODES)
        & ~c("audio_format").isin("flac", "wav"),
        "audio-item-format": audio & wanted.isNotNull() & ~wanted.isin(*_FORMATS["audio"]),
        "target-options": (mode == "target-size") & _not(target_ok),
    }


def lossless_conflict(df: DataFrame) -> DataFrame:
    """Add ``conflict``: why an image or audio item cannot run in a lossless mode.

    ``df``: kind, processing_mode, enhanced, ai, item_format, image_encoding.
    """
    c = F.col
    strict = c("processing_mode").isin(*dims.STRICT_LOSSLESS_MODES)
    image, audio = c("kind") == "image", c("kind") == "audio"
    keeps = c("item_format").isin("png", "tiff") | (
        c("item_format").isin("webp", "avif") & (c("image_encoding") == "lossless")
    )
    conflict = (
        F.when(~strict, F.lit(None))
        .when(image & (c("enhanced") | c("ai")), "LOSSLESS_SETTINGS_CONFLICT")
        .when(image & ~keeps, "LOSSLESS_OUTPUT_REQUIRED")
        .when(audio & ~c("item_format").isin("flac", "wav"), "LOSSLESS_AUDIO_OUTPUT_REQUIRED")
    )
    return df.withColumn("conflict", conflict)


def audit_settings(items: DataFrame) -> DataFrame:
    """Every broken rule of every batch: ``batch_id, rule, items``.

    Only queued, failed and cancelled items are checked; a batch without any breaks
    ``no-items``.
    """
    active = F.col("status").isin("queued", "error", "cancelled")
    rules = settings_rules("target_preset" in items.columns)
    broken = F.array_compact(F.array(*[F.when(cond, F.lit(n)) for n, cond in rules.items()]))
    by_item = (
        items.filter(active)
        .select("batch_id", F.explode(broken).alias("rule"))
        .groupBy("batch_id", "rule")
        .agg(F.count(F.lit(1)).alias("items"))
    )
    idle = (
        items.groupBy("batch_id")
        .agg(F.bool_or(active).alias("__any"))
        .filter(~F.col("__any"))
        .select("batch_id", F.lit("no-items").alias("rule"), F.lit(0).cast("bigint").alias("items"))
    )
    return by_item.unionByName(idle)


def needs_reencode() -> Column:
    """Whether a video's options change the picture."""
    c = F.col
    return (
        (c("video_mode") == "compress")
        | (c("video_resolution") != "original")
        | (F.coalesce(c("frame_rate"), F.lit("original")) != "original")
        | F.coalesce(c("enhanced"), F.lit(False))
    )


def route_files(items: DataFrame) -> DataFrame:
    """Processing path and encoder of every image and video.

    ``items``: kind, size_bytes, requested_bytes?, ai, video_mode, video_resolution,
    frame_rate, enhanced, video_codec, hardware_encoder.
    """
    c = F.col
    video = c("kind") == "video"
    done = F.coalesce(c("size_bytes") <= c("requested_bytes"), F.lit(False))
    path = (
        F.when(done, "return-original")
        .when(video & c("ai"), "ai-enhancement")
        .when(video & ~needs_reencode(), "stream-copy")
        .when(video & c("hardware_encoder").isNotNull(), "hardware-encode")
        .when(video, "software-encode")
        .when(c("ai"), "ai-processing")
        .otherwise("image-optimization")
    )
    encoder = F.when(c("path") == "hardware-encode", c("hardware_encoder")).when(
        c("path") == "software-encode", dims.lookup(c("video_codec"), dims.SOFTWARE_ENCODERS)
    )
    return items.filter(c("kind").isin("image", "video")).withColumn("path", path).withColumn(
        "encoder", encoder
    )


def route_counts(routed: DataFrame) -> DataFrame:
    return routed.groupBy("kind", "path", "encoder").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes")
    )


def _first_match(rules, default: str | None, format_name: Column, name: Column, codec: Column | None = None) -> Column:
    """Result of the first rule that fits a file, out of a table of fixed values.

    A rule names probe formats (any of them), a start of the codec, an end of the file name
    (empty: any) and its result.
    """
    names, lower = F.transform(F.split(F.lower(format_name), ","), F.trim), F.lower(name)
    found = F.when(F.lit(False), F.lit(default))
    for formats, start, end, result in rules:
        fits = F.arrays_overlap(names, F.array(*[F.lit(f) for f in formats]))
        if start:
            fits = fits & (F.startswith(codec, F.lit(start)) if start.endswith("_") else codec == start)
        if end:
            fits = fits & F.endswith(lower, F.lit(end))
        found = found.when(fits, result)
    return found.otherwise(F.lit(default)) if default else found


def source_container(format_name: Column, name: Column) -> Column:
    """Container of a source video from its probe names and file name."""
    return _first_match(dims.SOURCE_CONTAINERS, "mkv", format_name, name)


def output_container(selected: Column, reencode: Column, codec: Column, source: Column) -> Column:
    chosen = F.nullif(F.coalesce(selected, F.lit("source")), F.lit("source"))
    by_codec = F.when(codec.isin("vp9", "av1"), "webm").otherwise("mp4")
    return F.coalesce(chosen, F.when(reencode, by_codec).otherwise(source))


def copyable_video(codec: Column, container: Column) -> Column:
    ok = container.isNull() | container.isin("source", "mkv")
    for name, codecs in dims.COPYABLE_VIDEO.items():
        ok = ok | ((container == name) & F.lower(codec).isin(*codecs))
    return ok


def copyable_audio(codec: Column, container: Column) -> Column:
    ok = codec.isNull() | container.isNull() | container.isin("source", "mkv")
    for name, codecs in dims.COPYABLE_AUDIO.items():
        ok = ok | ((container == name) & F.lower(codec).isin(*codecs))
    return ok | ((container == "mov") & F.startswith(F.lower(codec), F.lit("pcm_")))


def audio_copy_format(format_name: Column, codec: Column, name: Column) -> Column:
    """Output format an audio source can be copied to, or null."""
    return _first_match(dims.AUDIO_COPY_FORMATS, None, format_name, name, codec)


def strict_container(format_name: Column, name: Column) -> Column:
    """Container of a lossless stream copy: the file's own extension if it is a known one."""
    ext = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    return F.when(ext.isin(*dims.STRICT_EXTENSIONS), ext).otherwise(
        _first_match(dims.STRICT_CONTAINERS, "mkv", format_name, name)
    )


def copy_formats(files: DataFrame) -> DataFrame:
    """What a stream copy of each file can go to: ``audio_format`` (null: none) of audio files,
    ``strict_container`` of videos. ``files``: file_id, kind, name, format_name, codec."""
    c = F.col
    return files.withColumns({
        "audio_format": F.when(c("kind") == "audio", audio_copy_format(c("format_name"), c("codec"), c("name"))),
        "strict_container": F.when(c("kind") == "video", strict_container(c("format_name"), c("name"))),
    })


def container_flow(files: DataFrame) -> DataFrame:
    """Source and output container of every video and whether its streams can be copied.

    ``files``: file_id, name, format_name, video_source_codec, audio_source_codec,
    selected_container, reencode, video_codec, copy_audio.
    """
    c = F.col
    rows = files.withColumn("source_container", source_container(c("format_name"), c("name")))
    rows = rows.withColumn(
        "output_container",
        output_container(
            c("selected_container"), c("reencode"), c("video_codec"), c("source_container")
        ),
    )
    video_ok = copyable_video(c("video_source_codec"), c("output_container"))
    audio_ok = copyable_audio(c("audio_source_codec"), c("output_container"))
    broken = (~c("reencode") & (~video_ok | ~audio_ok)) | (
        c("reencode") & c("copy_audio") & ~audio_ok
    )
    return rows.withColumn("incompatible", broken)


def flow_matrix(flow: DataFrame) -> DataFrame:
    return flow.groupBy("source_container", "output_container").agg(
        F.count(F.lit(1)).alias("files"), F.count_if("incompatible").alias("incompatible_files")
    )
