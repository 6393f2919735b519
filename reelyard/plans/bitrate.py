"""Byte targets and bitrate plans for a whole catalog.

The ladders have at most six steps, so "first step that fits" is a chain of ``CASE``
expressions inside the scan stage: planning a file needs no join and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions.numbers import SAFE_INTEGER, fixed, half_up, share
from ..functions.staging import settle


def resolve_targets(files: DataFrame, preset: Column | None = None) -> DataFrame:
    """Add ``requested_bytes``, ``needs_reduction`` and ``reject_reason``.

    An absolute target wins over a ratio. With ``preset`` the preset's values fill in
    where the row has none. Rows with a ``reject_reason`` carry no requested bytes.
    """
    columns = set(files.columns)
    target = F.col("target_bytes") if "target_bytes" in columns else F.lit(None).cast("bigint")
    ratio = F.col("target_ratio") if "target_ratio" in columns else F.lit(None).cast("double")
    if preset is not None:
        by_bytes = {p: b for p, b, _ in dims.TARGET_PRESETS if b is not None}
        by_ratio = {p: r for p, _, r in dims.TARGET_PRESETS if r is not None}
        target = F.when(
            target.isNull() & ratio.isNull(), dims.lookup(preset, by_bytes).cast("bigint")
        ).otherwise(target)
        ratio = F.coalesce(ratio, dims.lookup(preset, by_ratio))
    size = F.col("size_bytes")
    good_size = (size > 0) & (size <= SAFE_INTEGER)
    good_target = (target > 0) & (target <= SAFE_INTEGER)
    good_ratio = ratio.isNotNull() & ~F.isnan(ratio) & (ratio > 0) & (ratio < float("inf"))
    reason = (
        F.when(~F.coalesce(good_size, F.lit(False)), "invalid-original")
        .when(target.isNotNull() & ~good_target, "invalid-target")
        .when(target.isNull() & ~good_ratio, "invalid-ratio")
    )
    requested = F.when(
        reason.isNull(),
        F.coalesce(
            target, F.greatest(F.lit(1).cast("bigint"), F.floor(size.cast("double") * ratio))
        ),
    )
    return settle(
        files, {"requested_bytes": requested, "reject_reason": reason}
    ).withColumn("needs_reduction", F.col("requested_bytes") < size)


def accepted(targets: DataFrame) -> DataFrame:
    return targets.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(targets: DataFrame) -> DataFrame:
    return targets.filter(F.col("reject_reason").isNotNull())


def bounded_ratio(value: float, default: float) -> float:
    return value if 0 <= value <= dims.MAX_RATIO else default


def audio_floor(minimum: Column) -> Column:
    """The lowest allowed ladder step; anything off the ladder means 64."""
    return F.when(minimum.isin(*dims.AUDIO_LADDER_KBPS), minimum).otherwise(F.lit(64))


def audio_start(mode: Column) -> Column:
    """Highest step worth trying: the requested one, or the source rate per track."""
    fixed_step = mode.try_cast("int")
    per_track = F.when(
        (F.col("audio_kbps") > 0) & (F.col("audio_track_count") > 0),
        F.try_divide(F.col("audio_kbps"), F.col("audio_track_count")),
    ).otherwise(F.lit(320.0))
    step = F.coalesce(
        *[F.when(per_track >= s, F.lit(s)) for s in dims.AUDIO_LADDER_KBPS], F.lit(64)
    )
    return F.when(mode.isin("auto", "remove"), step).otherwise(fixed_step)


def _audio_columns(files: DataFrame) -> tuple[Column, Column]:
    columns = set(files.columns)
    mode = F.col("audio_mode") if "audio_mode" in columns else F.lit("auto")
    minimum = F.col("minimum_audio_kbps") if "minimum_audio_kbps" in columns else F.lit(64)
    return mode, minimum


def audio_candidates(files: DataFrame) -> DataFrame:
    """One row per file and allowed audio step; the floor alone when none is allowed."""
    mode, minimum = _audio_columns(files)
    start, floor_step = audio_start(mode), audio_floor(minimum)
    steps = files.select(
        "file_id", start.alias("start_kbps"), floor_step.alias("floor_kbps"),
        F.explode(dims.int_array(dims.AUDIO_LADDER_KBPS)).alias("step_kbps"),
    )
    step, first, last = F.col("step_kbps"), F.col("start_kbps"), F.col("floor_kbps")
    return steps.filter(
        ((step <= first) & (step >= last)) | ((first < last) & (step == last))
    ).select("file_id", "step_kbps")


def plan_bitrates(
    targets: DataFrame,
    safety_margin: float = dims.SAFETY_MARGIN,
    container_overhead: float = dims.CONTAINER_OVERHEAD,
) -> DataFrame:
    """Bitrate plan of every file that has a requested size and a duration.

    Expects the columns of ``media_files`` plus ``requested_bytes``.
    """
    margin = bounded_ratio(safety_margin, dims.SAFETY_MARGIN)
    overhead = bounded_ratio(container_overhead, dims.CONTAINER_OVERHEAD)
    mode, minimum = _audio_columns(targets)
    timed = targets.filter(
        (F.col("duration_s") > 0) & (F.col("size_bytes") > 0) & (F.col("requested_bytes") > 0)
    )
    no_audio = (mode == "remove") | (F.col("audio_track_count") == 0)
    gross = F.col("requested_bytes").cast("double") * 8 / F.col("duration_s") / 1000
    rates = settle(
        timed,
        {
            "__gross": gross,
            "__start": audio_start(mode),
            "__floor": audio_floor(minimum),
            "remove_audio": no_audio,
            "track_count": F.when(no_audio, F.lit(0)).otherwise(
                F.greatest(F.lit(1), F.col("audio_track_count"))
            ),
        },
    ).withColumns({"__margin": F.col("__gross") * margin, "__overhead": F.col("__gross") * overhead})
    rates = rates.withColumn(
        "__usable",
        F.greatest(F.lit(0.0), F.col("__gross") - F.col("__margin") - F.col("__overhead")),
    )
    fits = [
        F.when(
            (F.lit(s) <= F.col("__start")) & (F.lit(s) >= F.col("__floor"))
            & (F.col("__usable") - s * F.col("track_count") >= dims.MIN_VIDEO_KBPS),
            F.lit(s),
        )
        for s in dims.AUDIO_LADDER_KBPS
    ]
    planned = settle(
        rates,
        {
            "audio_kbps_per_track": F.when(
                ~F.col("remove_audio"), F.coalesce(*fits, F.col("__floor"))
            )
        },
    )
    planned = planned.withColumn(
        "audio_kbps_total",
        F.coalesce(F.col("audio_kbps_per_track") * F.col("track_count"), F.lit(0)),
    )
    available = F.greatest(
        F.lit(0.0),
        F.col("__gross") - F.col("__margin") - F.col("__overhead") - F.col("audio_kbps_total"),
    )
    feasible = F.when(
        F.col("kind") == "audio",
        F.col("__usable") >= F.coalesce(F.col("audio_kbps_per_track"), F.lit(64)),
    ).otherwise(available >= dims.MIN_VIDEO_KBPS)
    video = F.greatest(
        F.lit(dims.MIN_VIDEO_KBPS).cast("bigint"),
        F.floor(F.col("__usable") - F.col("audio_kbps_total")),
    )
    return planned.withColumns(
        {
            "gross_kbps": fixed(F.col("__gross"), 1),
            "usable_kbps": fixed(F.col("__usable"), 1),
            "safety_margin_kbps": fixed(F.col("__margin"), 1),
            "container_overhead_kbps": fixed(F.col("__overhead"), 1),
            "video_kbps": video,
            "feasible": feasible,
        }
    ).drop("__gross", "__margin", "__overhead", "__usable", "__start", "__floor")


def plan_audio(targets: DataFrame) -> DataFrame:
    """Audio-only plan: the highest step whose tracks fit, or unreachable."""
    mode, minimum = _audio_columns(targets)
    ratio = (
        1
        - bounded_ratio(dims.SAFETY_MARGIN, 0.03)
        - bounded_ratio(dims.CONTAINER_OVERHEAD, 0.015)
    )
    tracks = F.greatest(F.lit(1), F.col("audio_track_count"))
    files = targets.filter(
        (F.col("kind") == "audio") & (F.col("duration_s") > 0) & (F.col("requested_bytes") > 0)
    )
    files = settle(
        files,
        {
            "__usable": F.col("requested_bytes").cast("double") * 8 / F.col("duration_s") / 1000
            * F.lit(ratio),
            "__start": audio_start(mode),
            "__floor": audio_floor(F.greatest(F.lit(64), minimum)),
        },
    )
    start, floor_step = F.col("__start"), F.col("__floor")
    fits = [
        F.when(
            (((F.lit(s) <= start) & (F.lit(s) >= floor_step))
             | ((start < floor_step) & (F.lit(s) == floor_step)))
            & (s * tracks <= F.col("__usable")),
            F.lit(s),
        )
        for s in dims.AUDIO_LADDER_KBPS
    ]
    files = settle(files, {"__step": F.when(mode != "remove", F.coalesce(*fits))})
    step = F.col("__step")
    within = F.col("size_bytes") <= F.col("requested_bytes")
    outcome = (
        F.when(within, "already-within-target")
        .when(mode == "remove", "only-audio-removed")
        .when(step.isNull(), "unreachable")
        .otherwise("planned")
    )
    floor_bytes = F.ceil(64 * tracks * 1000 * F.col("duration_s") / 8)
    return files.select(
        "*",
        outcome.alias("outcome"),
        F.when(outcome == "planned", step).alias("step_kbps"),
        F.when(outcome.isin("unreachable", "only-audio-removed"), floor_bytes).alias(
            "minimum_bytes"
        ),
    ).drop("__usable", "__start", "__floor", "__step")


def minimum_bytes(plan: DataFrame) -> DataFrame:
    """Add the smallest size worth asking for: lowest video rate plus planned audio."""
    rate = F.lit(dims.MIN_VIDEO_KBPS) + F.col("audio_kbps_total")
    return plan.withColumn(
        "minimum_bytes", F.ceil(rate * 1000 * F.col("duration_s") / 8).cast("bigint")
    )


def feasibility_columns(
    original: Column, target: Column, minimum: Column, estimated: Column | None = None
) -> dict[str, Column]:
    """Band, quality impact and expected size of a byte target."""
    reduction = F.greatest(
        F.lit(0.0), 1 - share(target, F.greatest(F.lit(1).cast("bigint"), original))
    )
    no_work = target >= original
    reachable = target >= minimum
    near = target >= minimum * 0.85
    band = (
        F.when(no_work, "achievable")
        .when(reachable & (reduction <= 0.35), "achievable")
        .when(reachable & (reduction <= 0.65), "settings-recommended")
        .when(reachable | near, "quality-risk")
        .otherwise("difficult")
    )
    impact = (
        F.when(no_work, "none")
        .when(reachable & (reduction <= 0.35), "small")
        .when(reachable & (reduction <= 0.65), "moderate")
        .otherwise("large")
    )
    expected = estimated if estimated is not None else F.greatest(target, minimum)
    output = F.greatest(F.lit(1).cast("bigint"), half_up(expected.cast("double")))
    percent = F.when(
        original > 0, fixed(share(original - output, original) * 100, 1)
    ).otherwise(F.lit(0.0))
    return {
        "feasibility": band,
        "quality_impact": impact,
        "estimated_output_bytes": output,
        "estimated_reduction_percent": percent,
    }


def feasibility(plan: DataFrame) -> DataFrame:
    """Feasibility of each plan from ``size_bytes``, ``requested_bytes``, ``minimum_bytes``."""
    return plan.withColumns(
        feasibility_columns(
            F.col("size_bytes"), F.col("requested_bytes"), F.col("minimum_bytes")
        )
    )


def sample_windows(files: DataFrame, seconds: float = dims.SAMPLE_SECONDS) -> DataFrame:
    """Start, middle and end windows of each timed file; equal starts appear once."""
    length = F.least(F.greatest(F.lit(0.5), F.lit(float(seconds))), F.col("duration_s"))
    timed = files.filter(F.col("duration_s") > 0).select("file_id", "duration_s", length.alias("window_s"))
    starts = [
        F.lit(0.0),
        fixed(F.greatest(F.lit(0.0), F.col("duration_s") / 2 - F.col("window_s") / 2), 3),
        fixed(F.greatest(F.lit(0.0), F.col("duration_s") - F.col("window_s")), 3),
    ]
    return timed.select(
        "file_id", F.explode(F.array_distinct(F.array(*starts))).alias("start_s"), "window_s"
    )
