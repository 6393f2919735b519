"""Per-batch analysis, use-case presets and estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions.numbers import exact_sum, fixed, half_up, share
from .bitrate import feasibility_columns, resolve_targets


def analyze_batches(files: DataFrame) -> DataFrame:
    """Bytes, kinds, longest edge, longest duration and transparency per batch.

    All aggregates combine map-side, so a batch with a third of all files sends one
    partial row per task.
    """
    known = F.when(F.col("kind").isin("image", "video", "audio"), F.col("kind"))
    edge = F.greatest(F.coalesce("width", F.lit(0)), F.coalesce("height", F.lit(0)))
    return files.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("size_bytes").alias("total_bytes"),
        F.array_join(F.sort_array(F.collect_set(known)), ",").alias("kinds"),
        F.nullif(F.max(edge), F.lit(0)).alias("max_long_edge"),
        F.nullif(F.max(F.coalesce("duration_s", F.lit(0.0))), F.lit(0.0)).alias("max_duration_s"),
        F.coalesce(F.bool_or("has_alpha"), F.lit(False)).alias("has_transparency"),
    )


def _has(kind: str) -> Column:
    return F.array_contains(F.split("kinds", ","), kind)


def recommend_use_case(batches: DataFrame) -> DataFrame:
    """Best-fitting use case of each analysed batch."""
    media = _has("video") | _has("audio")
    total = F.col("total_bytes")
    choice = (
        F.when(media & (total > 20 * dims.MB), "smartphone")
        .when(media, "social")
        .when((F.coalesce("max_long_edge", F.lit(0)) >= 4000) & (total < 12 * dims.MB), "print")
        .otherwise("web")
    )
    return batches.withColumn("use_case", choice)


def resolve_presets(batches: DataFrame) -> DataFrame:
    """Every batch under each of the seven presets: target, reduction, size, seconds."""
    fields = [
        (n if n != "max_long_edge" else "preset_long_edge", t)
        for n, t in dims.USE_CASE_PRESET_FIELDS
    ]
    rows = batches.select("*", F.inline(dims.struct_array(dims.USE_CASE_PRESETS, fields)))
    images_only = F.col("kinds") == "image"
    megabytes = (
        F.when(images_only & (F.col("files") == 1), F.col("image_mb"))
        .when(images_only, F.col("many_images_mb"))
        .otherwise(F.col("media_mb"))
    )
    rows = rows.withColumn("target_bytes", megabytes.cast("bigint") * dims.MB)
    total, target = F.col("total_bytes"), F.col("target_bytes")
    rows = rows.withColumns(
        {
            "needs_target": F.coalesce(total > target, F.lit(False)),
            "shrinks_edge": F.coalesce(
                F.col("max_long_edge") > F.col("preset_long_edge"), F.lit(False)
            ),
            "image_format": F.when(
                F.col("has_transparency"), F.col("transparent_format")
            ).otherwise(F.col("photo_format")),
        }
    )
    boosted = (F.col("low_percent") + F.col("high_percent")) / 2 + F.when(
        F.col("shrinks_edge"), 8
    ).otherwise(0)
    needed = F.when(F.col("needs_target"), (1 - share(target, total)) * 100).otherwise(F.lit(0.0))
    percent = half_up(
        F.least(F.lit(90.0), F.greatest(F.col("low_percent").cast("double"), boosted, needed))
    )
    rows = rows.withColumn("reduction_percent", percent)
    output = F.least(total, half_up(total * (1 - F.col("reduction_percent") / 100)))
    seconds = F.greatest(
        F.lit(2).cast("bigint"),
        half_up(
            total / dims.MB * F.col("seconds_per_mb")
            + F.coalesce("max_duration_s", F.lit(0.0)) * 0.18
        ),
    )
    ratio = F.when(
        F.col("needs_target"),
        F.greatest(F.lit(0.01), F.least(F.lit(0.99), share(target, total))),
    ).otherwise(F.lit(0.5))
    lossless = F.col("image_format").isin("png", "tiff") | (F.col("image_encoding") == "lossless")
    return rows.select(
        "batch_id", "preset_id", "target_bytes", "needs_target", "reduction_percent",
        output.alias("estimated_output_bytes"),
        seconds.alias("estimated_seconds"),
        ratio.alias("target_ratio"),
        F.when(F.col("needs_target"), "target-size").otherwise(F.col("preset_mode")).alias(
            "processing_mode"
        ),
        "image_format",
        F.when(lossless, "lossless").otherwise(F.col("image_encoding")).alias("image_encoding"),
        F.when(F.col("shrinks_edge"), F.col("preset_long_edge")).alias("image_long_edge"),
        "speed_preset",
    )


def estimate_batches(
    files: DataFrame,
    target_ratio: float | None = 0.5,
    target_bytes: int | None = None,
    processing_mode: str = "reduce-size",
    quality: int = 82,
    video_quality: str = "balanced",
) -> DataFrame:
    """Expected output of each batch, with a feasibility band when a target is set.

    "First video" and "first audio" follow the input order ``file_id``.
    """
    video, audio = F.col("kind") == "video", F.col("kind") == "audio"
    batches = files.groupBy("batch_id").agg(
        F.sum("size_bytes").alias("size_bytes"),
        F.bool_or(video).alias("has_video"),
        F.bool_or(audio).alias("has_audio"),
        F.min_by(
            F.when(video, F.struct("height", "duration_s")), F.when(video, F.col("file_id"))
        ).alias("first_video"),
        F.min_by(F.when(audio, F.col("duration_s")), F.when(audio, F.col("file_id"))).alias(
            "first_audio_s"
        ),
    )
    total = F.col("size_bytes")
    factor = (
        F.lit(0.96)
        if processing_mode == "metadata-only" or processing_mode in dims.STRICT_LOSSLESS_MODES
        else F.lit(
            0.78 if quality >= 90 or video_quality == "high"
            else 0.42 if quality <= 72 or video_quality == "small"
            else 0.62
        )
    )
    if target_ratio is None and target_bytes is None:
        output = half_up(total * factor)
        return batches.select(
            "batch_id",
            total.alias("input_bytes"),
            output.alias("output_bytes"),
            F.greatest(F.lit(0).cast("bigint"), total - output).alias("saved_bytes"),
        )
    asked = batches.withColumns(
        {
            "target_bytes": F.lit(target_bytes).cast("bigint"),
            "target_ratio": F.lit(target_ratio).cast("double"),
        }
    )
    asked = resolve_targets(asked)
    target = F.col("requested_bytes")
    ratio = share(target, total)
    source = F.col("first_video.height")
    rung = (
        F.when(ratio >= 0.55, source)
        .when(ratio >= 0.35, F.lit(1080))
        .when(ratio >= 0.2, F.lit(720))
        .otherwise(F.lit(480))
    )
    height = F.when(source.isNotNull(), F.least(source, rung))
    floor_share = F.when(F.col("has_video"), 0.18).when(F.col("has_audio"), 0.22).otherwise(0.08)
    minimum = F.greatest(F.lit(1).cast("bigint"), half_up(total * floor_share))
    seconds = (
        F.when(
            F.col("has_video"),
            F.greatest(
                F.lit(5).cast("bigint"),
                half_up(F.coalesce(F.col("first_video.duration_s"), F.lit(5.0)) * 2.2),
            ),
        )
        .when(
            F.col("has_audio"),
            F.greatest(
                F.lit(2).cast("bigint"),
                half_up(F.coalesce("first_audio_s", F.lit(2.0)) * 0.35),
            ),
        )
        .otherwise(F.lit(11).cast("bigint"))
    )
    asked = asked.withColumns({"minimum_bytes": minimum, "recommended_height": height})
    expected = F.when(target >= total, total).otherwise(F.greatest(target, F.col("minimum_bytes")))
    bands = feasibility_columns(total, target, F.col("minimum_bytes"), expected)
    estimated = asked.withColumns({**bands, "estimated_seconds": seconds})
    by_target = F.least(F.lit(1.0), share(F.col("estimated_output_bytes"), total))
    output = half_up(total * F.coalesce(by_target, factor))
    return estimated.select(
        "batch_id",
        total.alias("input_bytes"),
        target.alias("target_bytes"),
        "minimum_bytes", "recommended_height", "feasibility", "quality_impact",
        "estimated_seconds",
        output.alias("output_bytes"),
        F.greatest(F.lit(0).cast("bigint"), total - output).alias("saved_bytes"),
    )


def estimate_from_samples(samples: DataFrame, files: DataFrame) -> DataFrame:
    """Extrapolate encoded samples to whole files.

    ``samples``: file_id, duration_s, output_bytes, processing_s.
    ``files``: file_id, duration_s, size_bytes, requested_bytes, and optionally
    height and recommended_height. Samples are summed per file before the join.
    """
    per_file = samples.groupBy("file_id").agg(
        F.sum("duration_s").alias("sampled_s"),
        F.sum("output_bytes").alias("sampled_bytes"),
        exact_sum(F.coalesce("processing_s", F.lit(0.0))).alias("spent_s"),
        F.count(F.lit(1)).alias("samples"),
    )
    rows = files.join(per_file, "file_id").filter(
        (F.col("sampled_s") > 0) & (F.col("duration_s") > 0) & (F.col("size_bytes") > 0)
    )
    rate = share(F.col("sampled_bytes"), F.col("sampled_s"))
    spent = share(F.col("spent_s"), F.col("sampled_s"))
    original, duration = F.col("size_bytes"), F.col("duration_s")
    rows = rows.withColumn(
        "estimated_output_bytes",
        F.greatest(F.lit(1).cast("bigint"), half_up(rate * duration)),
    )
    output = F.col("estimated_output_bytes")
    ratio = share(output, F.col("requested_bytes"))
    return rows.withColumns(
        {
            "estimated_reduction_percent": fixed(share(original - output, original) * 100, 1),
            "estimated_seconds": F.greatest(
                F.lit(1).cast("bigint"),
                half_up(F.when(spent > 0, spent * duration).otherwise(duration)),
            ),
            "quality_impact": F.when(ratio <= 0.85, "small")
            .when(ratio <= 1.05, "moderate")
            .otherwise("large"),
            "feasibility": F.when(ratio <= 1, "achievable")
            .when(ratio <= 1.1, "settings-recommended")
            .otherwise("difficult"),
        }
    )
