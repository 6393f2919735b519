"""Frame scores, low-quality segments and pixel error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import exact_mean, fixed
from .running import CHUNK_ROWS, numbered


def pool_scores(frames: DataFrame, pooled: DataFrame | None = None) -> DataFrame:
    """Mean and minimum score per candidate; given pooled values win.

    ``frames``: candidate_id, frame, score. ``pooled``: candidate_id, pooled_mean, pooled_min.
    """
    scored = frames.filter(F.col("score").isNotNull() & ~F.isnan("score"))
    measured = scored.groupBy("candidate_id").agg(
        exact_mean(F.col("score")).alias("__mean"), F.min("score").alias("__min"),
        F.count(F.lit(1)).alias("frames"),
    )
    if pooled is None:
        mean, low, rows = F.col("__mean"), F.col("__min"), measured
    else:
        rows = measured.join(pooled, "candidate_id", "full_outer")
        mean = F.coalesce("pooled_mean", "__mean")
        low = F.coalesce("pooled_min", "__min")
    return rows.select(
        "candidate_id", fixed(mean, 3).alias("mean_score"), fixed(low, 3).alias("min_score"),
        F.coalesce("frames", F.lit(0).cast("bigint")).alias("frames"),
    ).filter(F.col("mean_score").isNotNull() & F.col("min_score").isNotNull())


def low_segments(
    frames: DataFrame, threshold: Column | float, fps: Column | float = 1.0, size: int = CHUNK_ROWS
) -> DataFrame:
    """Runs of consecutive frames below the threshold: start, end, lowest score.

    The threshold and the frame rate may be columns, such as options of each file; without a
    threshold (null) nothing is low. Gaps and islands on frame numbers. The rank is a chunked running count, so one long
    recording is scanned by many tasks.
    """
    rate = fps if isinstance(fps, Column) else F.lit(float(fps))
    rate = F.when(rate > 0, rate).otherwise(F.lit(1.0))
    low = frames.filter(F.col("score") < (threshold if isinstance(threshold, Column) else F.lit(float(threshold)))).select(
        "candidate_id", "frame", "score", rate.alias("__fps")
    )
    ranked = numbered(low, ["candidate_id"], ["frame"], "__rank", size=size)
    islands = ranked.groupBy(
        "candidate_id", (F.col("frame") - F.col("__rank")).alias("__island")
    ).agg(
        F.min("frame").alias("first_frame"),
        F.max("frame").alias("last_frame"),
        F.min("score").alias("lowest"),
        F.max("__fps").alias("__fps"),
    )
    return islands.select(
        "candidate_id", "first_frame", "last_frame",
        fixed(F.col("first_frame") / F.col("__fps"), 3).alias("start_s"),
        fixed((F.col("last_frame") + 1) / F.col("__fps"), 3).alias("end_s"),
        fixed(F.col("lowest"), 3).alias("score"),
    )


def pixel_error(before: DataFrame, after: DataFrame) -> DataFrame:
    """Peak signal-to-noise ratio of image pairs ``image_id, pixels`` (0..255).

    Null when the pixel counts differ; ``infinite`` marks equal images.
    """
    pairs = before.select("image_id", F.col("pixels").alias("a")).join(
        after.select("image_id", F.col("pixels").alias("b")), "image_id"
    )
    squares = F.zip_with("a", "b", lambda x, y: ((x - y) * (x - y)).cast("bigint"))
    total = F.aggregate(squares, F.lit(0).cast("bigint"), lambda acc, v: acc + v)
    same_size = F.size("a") == F.size("b")
    rows = pairs.select(
        "image_id",
        same_size.alias("comparable"),
        F.size("a").alias("__n"),
        F.when(same_size, total).alias("squared_error"),
    )
    error = F.col("squared_error")
    ratio = F.lit(255.0 * 255.0) / (error / F.col("__n"))
    return rows.select(
        "image_id", "comparable", "squared_error",
        F.when(error > 0, fixed(F.log10(ratio) * 10, 3)).alias("psnr"),
        F.coalesce(error == 0, F.lit(False)).alias("infinite"),
    )
