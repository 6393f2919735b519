"""Probe documents to catalog rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from ..functions.parsing import frame_rate, positive
from ..functions.staging import settle

STREAM_SCHEMA = (
    "array<struct<index:int, codec_type:string, codec_name:string, width:double, height:double,"
    " duration:string, bit_rate:string, avg_frame_rate:string, r_frame_rate:string,"
    " sample_rate:string, channels:double, pix_fmt:string, bits_per_raw_sample:string,"
    " color_primaries:string, color_transfer:string, color_space:string, color_range:string,"
    " sample_aspect_ratio:string, display_aspect_ratio:string,"
    " side_data_list:array<struct<rotation:double>>,"
    " disposition:struct<attached_pic:int, `default`:int>, tags:map<string,string>>>"
)
PROBE_SCHEMA = (
    f"struct<streams:{STREAM_SCHEMA}, chapters:array<struct<id:int>>,"
    " format:struct<format_name:string, duration:string, size:string, bit_rate:string,"
    " tags:map<string,string>>>"
)
#: What planning reads of a document; fields that are not named are not built.
TARGET_STREAM_SCHEMA = (
    "array<struct<codec_type:string, codec_name:string, width:double, height:double, bit_rate:string,"
    " avg_frame_rate:string, r_frame_rate:string>>"
)
TARGET_SCHEMA = (
    f"struct<streams:{TARGET_STREAM_SCHEMA},"
    " format:struct<format_name:string, duration:string, size:string, bit_rate:string>>"
)
STREAM_TYPES = ("video", "audio", "subtitle", "attachment", "data")


def _streams(schema: str = STREAM_SCHEMA) -> Column:
    return F.coalesce("doc.streams", F.array().cast(schema))


def _first(condition, schema: str = STREAM_SCHEMA) -> Column:
    return F.get(F.filter(_streams(schema), condition), F.lit(0))


def _hdr(video: Column) -> Column:
    bits = positive(video["bits_per_raw_sample"])
    return F.coalesce(
        video["color_transfer"].isin("smpte2084", "arib-std-b67"), F.lit(False)
    ) | F.coalesce(video["color_primaries"] == "bt2020", F.lit(False)) | F.coalesce(
        video["pix_fmt"].rlike("10|12|p010|p012"), F.lit(False)
    ) | F.coalesce(bits >= 10, F.lit(False))


def parse_probes(raw: DataFrame) -> DataFrame:
    """Inspection rows from probe documents ``file_id, raw``.

    The first video stream that is not an attached picture and the first audio stream
    describe the file. ``reject_reason`` is set when the document is not JSON, or has no
    duration, or has neither stream.
    """
    parsed = settle(raw.select("file_id", "raw"), {"doc": F.from_json("raw", PROBE_SCHEMA)})
    picked = settle(
        parsed,
        {
            "video": _first(
                lambda s: (s["codec_type"] == "video")
                & (F.coalesce(s["disposition"]["attached_pic"], F.lit(0)) != 1)
            ),
            "audio": _first(lambda s: s["codec_type"] == "audio"),
        },
    )
    video, audio = F.col("video"), F.col("audio")
    duration = F.coalesce(
        positive(F.col("doc.format.duration")), positive(video["duration"]), positive(audio["duration"])
    )
    rotation = F.coalesce(
        F.get(
            F.filter(
                F.transform(video["side_data_list"], lambda d: d["rotation"]),
                lambda r: r.isNotNull(),
            ),
            F.lit(0),
        ),
        video["tags"]["rotate"].try_cast("double"),
    )
    reason = (
        F.when(F.col("doc").isNull() | (F.col("doc.streams").isNull() & F.col("doc.format").isNull()), "MEDIA_PROBE_FAILED")
        .when(duration.isNull() | (video.isNull() & audio.isNull()), "MEDIA_INFO_INCOMPLETE")
    )
    streams = F.transform(
        _streams(),
        lambda s: F.struct(
            F.coalesce(s["index"], F.lit(-1)).alias("idx"),
            F.when(s["codec_type"].isin(*STREAM_TYPES), s["codec_type"]).otherwise("unknown").alias("type"),
            F.coalesce(s["codec_name"], F.lit("unknown")).alias("codec"),
            s["tags"]["language"].alias("language"),
            s["tags"]["title"].alias("title"),
            s["tags"]["filename"].alias("filename"),
            (F.coalesce(s["disposition"]["default"], F.lit(0)) == 1).alias("is_default"),
            (F.coalesce(s["disposition"]["attached_pic"], F.lit(0)) == 1).alias("is_attached_picture"),
        ),
    )
    return picked.select(
        "file_id",
        F.when(video.isNotNull(), "video").otherwise("audio").alias("kind"),
        F.coalesce("doc.format.format_name", F.lit("unknown")).alias("format_name"),
        duration.alias("duration_s"),
        F.coalesce(
            positive(F.col("doc.format.bit_rate")), positive(video["bit_rate"]), positive(audio["bit_rate"])
        ).alias("bitrate"),
        F.coalesce(F.size("doc.chapters"), F.lit(0)).alias("chapter_count"),
        F.when(
            video.isNotNull(),
            F.struct(
                F.coalesce(positive(video["width"].cast("string")), F.lit(0.0)).cast("int").alias("width"),
                F.coalesce(positive(video["height"].cast("string")), F.lit(0.0)).cast("int").alias("height"),
                F.coalesce(video["codec_name"], F.lit("unknown")).alias("codec"),
                positive(video["bit_rate"]).alias("bitrate"),
                F.coalesce(frame_rate(video["avg_frame_rate"]), frame_rate(video["r_frame_rate"])).alias("fps"),
                video["pix_fmt"].alias("pixel_format"),
                rotation.alias("rotation"),
                _hdr(video).alias("hdr"),
            ),
        ).alias("video"),
        F.when(
            audio.isNotNull(),
            F.struct(
                F.coalesce(audio["codec_name"], F.lit("unknown")).alias("codec"),
                positive(audio["bit_rate"]).alias("bitrate"),
                positive(audio["sample_rate"]).alias("sample_rate"),
                positive(audio["channels"].cast("string")).alias("channels"),
            ),
        ).alias("audio"),
        streams.alias("streams"),
        F.size(F.filter(_streams(), lambda s: s["codec_type"] == "audio")).alias("audio_track_count"),
        F.coalesce("doc.format.tags", F.create_map().cast("map<string,string>")).alias("format_tags"),
        reason.alias("reject_reason"),
    )


def media_streams(probes: DataFrame) -> DataFrame:
    """One row per stream of each accepted probe."""
    return probes.filter(F.col("reject_reason").isNull()).select("file_id", F.inline("streams"))


def _kbps(bits: Column) -> Column:
    return F.when(bits.isNotNull(), half_up(bits / 1000))


def parse_target_probes(raw: DataFrame) -> DataFrame:
    """Planning rows from probe documents ``file_id, raw``: summed audio rate, codec list."""
    parsed = settle(raw.select("file_id", "raw"), {"doc": F.from_json("raw", TARGET_SCHEMA)})
    picked = settle(
        parsed,
        {
            "video": _first(lambda s: s["codec_type"] == "video", TARGET_STREAM_SCHEMA),
            "tracks": F.filter(_streams(TARGET_STREAM_SCHEMA), lambda s: s["codec_type"] == "audio"),
        },
    )
    video, tracks = F.col("video"), F.col("tracks")
    audio_bits = F.aggregate(
        tracks, F.lit(0.0), lambda acc, s: acc + F.coalesce(positive(s["bit_rate"]), F.lit(0.0))
    )
    duration = F.coalesce(positive(F.col("doc.format.duration")), F.lit(0.0))
    size = F.coalesce(positive(F.col("doc.format.size")), F.lit(0.0))
    reason = (
        F.when(F.col("doc").isNull() | (F.col("doc.streams").isNull() & F.col("doc.format").isNull()), "TARGET_SIZE_PROBE_FAILED")
        .when(duration <= 0, "ZERO_DURATION")
        .when(size <= 0, "EMPTY_FILE")
    )
    return picked.select(
        "file_id",
        F.when(video.isNotNull(), "video").otherwise("audio").alias("kind"),
        duration.alias("duration_s"),
        size.cast("bigint").alias("size_bytes"),
        F.coalesce("doc.format.format_name", F.lit("unknown")).alias("format_name"),
        _kbps(positive(F.col("doc.format.bit_rate"))).alias("total_kbps"),
        _kbps(positive(video["bit_rate"])).alias("video_kbps"),
        F.when(audio_bits > 0, half_up(audio_bits / 1000)).alias("audio_kbps"),
        positive(video["width"].cast("string")).cast("int").alias("width"),
        positive(video["height"].cast("string")).cast("int").alias("height"),
        F.coalesce(frame_rate(video["avg_frame_rate"]), frame_rate(video["r_frame_rate"])).alias("fps"),
        video["codec_name"].alias("video_codec"),
        F.transform(tracks, lambda s: F.coalesce(s["codec_name"], F.lit("unknown"))).alias("audio_codecs"),
        F.size(tracks).alias("audio_track_count"),
        reason.alias("reject_reason"),
    )


def target_probe_from_inspection(probes: DataFrame) -> DataFrame:
    """Planning rows from inspection rows plus ``size_bytes``; no second probe."""

    def kbps(bits: Column) -> Column:
        return F.when(bits.isNotNull(), F.greatest(F.lit(1).cast("bigint"), half_up(bits / 1000)))

    audio_codecs = F.transform(
        F.filter("streams", lambda s: s["type"] == "audio"), lambda s: s["codec"]
    )
    return probes.select(
        "file_id", "kind", "duration_s", "size_bytes", "format_name",
        kbps(F.col("bitrate")).alias("total_kbps"),
        kbps(F.col("video.bitrate")).alias("video_kbps"),
        kbps(F.col("audio.bitrate")).alias("audio_kbps"),
        F.col("video.width").alias("width"),
        F.col("video.height").alias("height"),
        F.col("video.fps").alias("fps"),
        F.col("video.codec").alias("video_codec"),
        audio_codecs.alias("audio_codecs"),
        "audio_track_count",
    )


def optimization_probe_from_inspection(probes: DataFrame) -> DataFrame:
    """Quality-search rows of the video files among the inspection rows."""
    return probes.filter((F.col("kind") == "video") & F.col("video").isNotNull()).select(
        "file_id", "format_name", "size_bytes", "duration_s",
        F.col("video.width").alias("width"), F.col("video.height").alias("height"),
        F.col("video.fps").alias("fps"), F.col("video.codec").alias("video_codec"),
        F.coalesce("video.hdr", F.lit(False)).alias("hdr"),
        "streams", "chapter_count", "format_tags",
    )
