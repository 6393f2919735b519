"""Resolution candidates and recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions.numbers import half_up


def minimum_kbps(height: Column, codec: Column, fps: Column) -> Column:
    """Lowest acceptable video rate for a height, codec and frame rate."""
    base = None
    for step, kbps in dims.HEIGHT_BASE_KBPS:
        base = F.when(height >= step, F.lit(kbps)) if base is None else base.when(height >= step, F.lit(kbps))
    base = base.otherwise(F.lit(dims.LOWEST_BASE_KBPS))
    efficiency = dims.lookup(codec, dims.CODEC_EFFICIENCY, F.lit(1.0))
    factor = F.least(F.lit(2.0), F.greatest(F.lit(0.75), F.coalesce(fps, F.lit(30.0)) / 30))
    return half_up(base * efficiency * factor)


def even_width(width: Column, height: Column, new_height: Column) -> Column:
    """Width at a new height, rounded to an even number, at least 2."""
    scaled = width.cast("double") * new_height / height / 2
    return F.greatest(F.lit(2).cast("bigint"), half_up(scaled) * 2)


def resolution_candidates(files: DataFrame, minimum_height: int = 480) -> DataFrame:
    """The source height and every ladder height below it, one row each.

    Expects ``file_id, width, height, fps, codec``. The five ladder steps are expanded
    from a constant array, so there is no join.
    """
    ladder = dims.int_array(dims.HEIGHT_LADDER)
    known = files.filter((F.col("width") > 0) & (F.col("height") > 0))
    expanded = known.select(
        "file_id", "width", "height", "fps", "codec",
        F.explode(F.array_distinct(F.concat(F.array(F.col("height")), ladder))).alias(
            "candidate_height"
        ),
    )
    candidate, source = F.col("candidate_height"), F.col("height")
    lower = (candidate < source) & (candidate >= minimum_height)
    return expanded.filter(lower | (candidate == source)).select(
        "file_id",
        "candidate_height",
        even_width(F.col("width"), source, candidate).alias("candidate_width"),
        minimum_kbps(candidate, F.col("codec"), F.col("fps")).alias("minimum_kbps"),
        (candidate == source).alias("is_source"),
    )


def recommend_resolution(
    plan: DataFrame, minimum_height: int = 480, allow_change: bool = True
) -> DataFrame:
    """Recommended and selected height of every planned video.

    Keep the source if its rate is sustainable; else the first lower rung that is; else
    the lowest lower rung there is.
    """
    height, video = F.col("height"), F.col("video_kbps")
    rungs = [h for h in dims.HEIGHT_LADDER if h >= minimum_height]
    sustainable = video >= minimum_kbps(height, F.col("codec"), F.col("fps"))
    first_fit = [
        F.when(
            (F.lit(h) < height)
            & (video >= minimum_kbps(F.lit(h), F.col("codec"), F.col("fps"))),
            F.lit(h),
        )
        for h in rungs
    ]
    lowest = [F.when(F.lit(h) < height, F.lit(h)) for h in reversed(rungs)]
    recommended = F.when(~sustainable, F.coalesce(*first_fit, *lowest))
    selected = F.when(F.lit(allow_change) & recommended.isNotNull(), recommended).otherwise(height)
    known = plan.filter((F.col("width") > 0) & (height > 0))
    return known.withColumns(
        {
            "source_sustainable": sustainable,
            "recommended_height": recommended,
            "selected_height": selected,
            "will_change": selected < height,
        }
    )
