"""Choosing among measured candidates and reporting the choice.

Candidates are reduced per file with ``min``/``max`` of fixed-width numbers or structs, which
combine map-side: a file with a third of all attempts sends one partial row per task. Ties go
to the smaller ordinal; the remaining columns make the order total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions.numbers import fixed, saved_percent, share


def _tie(df: DataFrame) -> list[str]:
    return [c for c in ("ordinal", "tie_a", "tie_b") if c in df.columns]


#: One more than the largest ordinal that ``_packed`` takes.
_ORDINALS = 1 << 31


def _packed(size: str, ordinal: str) -> Column:
    """Size and ordinal (0 to 2^31 - 1) as one decimal of the same order.

    A decimal has a buffer of fixed width, so its minimum hashes where that of a struct sorts.
    A larger or negative ordinal is an error, never a wrong choice.
    """
    place = F.col(ordinal).cast("bigint")
    checked = F.when((place >= 0) & (place < _ORDINALS), place).otherwise(
        F.raise_error(F.concat(F.lit("ordinal out of range: "), F.coalesce(place.cast("string"), F.lit("null")))).cast("bigint")
    )
    return (F.col(size).cast("decimal(19,0)") * F.lit(_ORDINALS).cast("decimal(10,0)") + checked).cast("decimal(31,0)")


def _unpacked(packed: str, size: str, ordinal: str) -> dict[str, Column]:
    whole = F.floor(F.col(packed) / F.lit(_ORDINALS).cast("decimal(10,0)"))
    rest = F.pmod(F.col(packed), F.lit(_ORDINALS).cast("decimal(10,0)"))
    return {size: whole.cast("bigint"), ordinal: rest.cast("int")}


def select_lossless(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """Smallest eligible, verified candidate if smaller than the original.

    ``candidates``: file_id, ordinal, output_bytes, eligible, verified.
    ``files``: file_id, size_bytes, strip_privacy, has_privacy.
    """
    usable = candidates.filter(F.col("eligible") & F.col("verified") & F.col("output_bytes").isNotNull())
    best = usable.groupBy("file_id").agg(
        F.min(_packed("output_bytes", "ordinal")).alias("best"), F.count(F.lit(1)).alias("verified_candidates")
    )
    rows = files.join(best, "file_id", "left").withColumns(_unpacked("best", "best_bytes", "best_ordinal"))
    satisfied = ~F.col("strip_privacy") | ~F.col("has_privacy")
    better = F.coalesce(F.col("best_bytes") < F.col("size_bytes"), F.lit(False))
    reason = (
        F.when(better & satisfied, "smaller-verified")
        .when(better, "smaller-verified-privacy")
        .when(~satisfied, "privacy-not-removed")
        .when(F.col("verified_candidates") > 0, "verified-not-smaller")
        .otherwise("no-verified-candidate")
    )
    output = F.when(better, F.col("best_bytes")).otherwise(F.col("size_bytes"))
    return rows.select(
        "file_id",
        F.when(better, F.col("best_ordinal")).alias("selected_ordinal"),
        output.alias("output_bytes"),
        (~better).alias("kept_original"),
        reason.alias("reason"),
        saved_percent(F.col("size_bytes"), output, 0.0).alias("reduction_percent"),
    )


def _or_default(df: DataFrame, column: str, default) -> Column:
    """A per-row option where the table has it, the default where it is missing or null."""
    return F.coalesce(F.col(column), F.lit(default)) if column in df.columns else F.lit(default)


def gate(
    candidates: DataFrame,
    mean_threshold: float = dims.VMAF_THRESHOLD,
    frame_threshold: float = dims.FRAME_THRESHOLD,
) -> DataFrame:
    """Add ``gate``: qualified, rejected or unavailable (no size or no score).

    Columns ``mean_threshold`` and ``frame_threshold`` of a candidate go before the defaults.
    """
    scored = (
        F.col("output_bytes").isNotNull()
        & F.col("vmaf_mean").isNotNull()
        & F.col("vmaf_min").isNotNull()
    )
    if "decoded" in candidates.columns:
        scored = scored & F.col("decoded")
    passes = (F.col("vmaf_mean") >= _or_default(candidates, "mean_threshold", mean_threshold)) & (
        F.col("vmaf_min") >= _or_default(candidates, "frame_threshold", frame_threshold)
    )
    return candidates.withColumn(
        "gate", F.when(~scored, "unavailable").when(passes, "qualified").otherwise("rejected")
    )


def select_quality(
    candidates: DataFrame,
    files: DataFrame,
    mean_threshold: float = dims.VMAF_THRESHOLD,
    frame_threshold: float = dims.FRAME_THRESHOLD,
) -> DataFrame:
    """Smallest candidate that passes the quality gate and is smaller than the original."""
    passing = gate(candidates, mean_threshold, frame_threshold).filter(
        F.col("gate") == "qualified"
    )
    best = passing.groupBy("file_id").agg(
        F.min(F.struct("output_bytes", *_tie(candidates), "codec")).alias("best"),
        F.count(F.lit(1)).alias("qualified_candidates"),
    )
    rows = files.join(best, "file_id", "left")
    better = F.coalesce(F.col("best.output_bytes") < F.col("size_bytes"), F.lit(False))
    output = F.when(better, F.col("best.output_bytes")).otherwise(F.col("size_bytes"))
    return rows.select(
        "file_id",
        F.col("size_bytes").alias("original_bytes"),
        output.alias("output_bytes"),
        F.when(better, F.col("best.codec")).alias("selected_codec"),
        F.when(better, F.col("best.ordinal")).alias("selected_ordinal"),
        (~better).alias("kept_original"),
        F.when(better, "qualified")
        .when(F.col("qualified_candidates") > 0, "not-smaller")
        .otherwise("none-qualified")
        .alias("decision"),
        saved_percent(F.col("size_bytes"), output, 0.0).alias("reduction_percent"),
    )


def candidate_tally(
    candidates: DataFrame,
    mean_threshold: float = dims.VMAF_THRESHOLD,
    frame_threshold: float = dims.FRAME_THRESHOLD,
) -> DataFrame:
    """Candidates by codec and gate status."""
    return (
        gate(candidates, mean_threshold, frame_threshold)
        .groupBy("codec", "gate")
        .agg(
            F.count(F.lit(1)).alias("candidates"),
            F.sum("output_bytes").alias("output_bytes"),
        )
    )


def report_tally(
    candidates: DataFrame,
    files: DataFrame,
    mean_threshold: float = dims.VMAF_THRESHOLD,
    frame_threshold: float = dims.FRAME_THRESHOLD,
) -> DataFrame:
    """Candidates by mode, codec and final status, ``selected`` for the one that a file keeps.

    ``files`` as for ``select_quality``, with ``mode``. Candidates are first counted per file,
    codec and gate; the file's choice then leaves ``qualified`` for ``selected``, so attempts
    are neither joined nor marked one by one. Candidates of unknown files have no mode.
    """
    counted = gate(candidates, mean_threshold, frame_threshold).groupBy("file_id", "codec", "gate").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("output_bytes"), F.lit(0).cast("bigint")).alias("bytes")
    )
    chosen = select_quality(candidates, files, mean_threshold, frame_threshold).select(
        "file_id", F.when(~F.col("kept_original"), F.lit("qualified")).alias("__gate"),
        F.col("selected_codec").alias("__codec"), F.col("output_bytes").alias("__bytes"),
    )
    rows = counted.join(files.select("file_id", "mode"), "file_id", "left").join(chosen, "file_id", "left")
    holds = (F.col("gate") == F.col("__gate")) & F.col("codec").eqNullSafe(F.col("__codec"))
    one = F.when(holds, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    size = F.when(holds, F.col("__bytes")).otherwise(F.lit(0)).cast("bigint")
    parts = F.array(
        F.struct(F.col("gate").alias("status"), (F.col("n") - one).alias("n"), (F.col("bytes") - size).alias("bytes")),
        F.struct(F.lit("selected").alias("status"), one.alias("n"), size.alias("bytes")),
    )
    return (
        rows.select("mode", "codec", F.inline(parts))
        .filter(F.col("n") > 0)
        .groupBy("mode", "codec", "status")
        .agg(F.sum("n").alias("candidates"), F.sum("bytes").alias("output_bytes"))
    )


def decision_tally(decisions: DataFrame) -> DataFrame:
    """Decisions by reason with the share of files that kept their original."""
    counts = decisions.groupBy("decision").agg(
        F.count(F.lit(1)).alias("files"), F.count_if("kept_original").alias("kept_files")
    )
    # one row per decision reason, three at most
    everything = F.sum("files").over(Window.partitionBy())
    return counts.select(
        "decision", "files", "kept_files",
        fixed(share(F.col("kept_files"), everything) * 100, 1).alias("kept_percent"),
    )


def select_for_target(attempts: DataFrame, files: DataFrame) -> DataFrame:
    """Highest quality whose bytes fit the target and beat the original.

    ``attempts``: file_id, quality, output_bytes, decoded, codec, ordinal.
    ``files``: file_id, size_bytes, requested_bytes, and where known quality_floor or
    output_format; the floor of a file is its own, its format's, or that of jpeg. Where
    nothing fits, the attempt at the floor is kept if it beats the original. Attempts are
    first reduced to the smallest one per (file, quality), at most a hundred rows per file,
    then joined. Bulk argmax over the measured attempts: the true best, not a bisection's.
    """
    ladder = (
        attempts.filter(F.col("decoded"))
        .groupBy("file_id", "quality")
        .agg(
            F.min(F.struct("output_bytes", *_tie(attempts), "codec")).alias("a"),
            F.count(F.lit(1)).alias("measured"),
        )
    )
    # Files keep their row without attempts; one join, then a fold on the same key.
    floor = F.lit(dims.QUALITY_FLOOR["jpeg"])
    if "output_format" in files.columns:
        floor = F.coalesce(dims.lookup(F.col("output_format"), dims.QUALITY_FLOOR), floor)
    if "quality_floor" in files.columns:
        floor = F.coalesce(F.col("quality_floor"), floor)
    sizes = files.select("file_id", "size_bytes", "requested_bytes", floor.alias("__floor"))
    joined = sizes.join(ladder, "file_id", "left")
    above = F.col("quality") >= F.col("__floor")
    size = F.when(above, F.col("a.output_bytes"))
    fits = (size <= F.col("requested_bytes")) & (size < F.col("size_bytes"))
    pick = F.struct("quality", "a")
    rows = joined.groupBy("file_id").agg(
        F.max("size_bytes").alias("size_bytes"),
        F.max("requested_bytes").alias("requested_bytes"),
        F.max_by(F.when(fits, pick), F.when(fits, F.col("quality"))).alias("best"),
        F.max_by(pick, F.when(F.col("quality") == F.col("__floor"), F.lit(1))).alias("lowest"),
        F.min(F.when(size < F.col("size_bytes"), size)).alias("smallest_bytes"),
        F.sum(F.when(above, F.col("measured"))).alias("attempts"),
    )
    original, target = F.col("size_bytes"), F.col("requested_bytes")
    no_work = target >= original
    floor_kept = F.coalesce(F.col("lowest.a.output_bytes") < original, F.lit(False))
    selected = (
        F.when(no_work, F.lit(None))
        .when(F.col("best").isNotNull(), F.col("best"))
        .when(floor_kept, F.col("lowest"))
    )
    rows = rows.withColumn("__selected", selected)
    actual = F.coalesce(F.col("__selected.a.output_bytes"), original)
    outcome = (
        F.when(no_work, "no-reduction-needed")
        .when(F.col("best").isNotNull(), "fits")
        .when(floor_kept, "floor-misses-target")
        .otherwise("original-kept")
    )
    tolerance = F.greatest(F.lit(1).cast("bigint"), F.floor(target * dims.IMAGE_TOLERANCE))
    return rows.select(
        "file_id",
        original.alias("original_bytes"),
        target.alias("requested_bytes"),
        actual.alias("actual_bytes"),
        F.col("__selected.quality").alias("selected_quality"),
        F.col("__selected.a.codec").alias("selected_codec"),
        F.coalesce("attempts", F.lit(0).cast("bigint")).alias("attempts"),
        F.least(original, F.coalesce("smallest_bytes", original)).alias("smallest_bytes"),
        outcome.alias("outcome"),
        (actual <= target).alias("achieved"),
        ((actual <= target) & (target - actual <= tolerance)).alias("within_tolerance"),
    )


#: Formats of a PNG source in the order of ``format_rank``.
PNG_FORMATS = ("png", "webp", "avif")


def select_png(attempts: DataFrame, files: DataFrame, allow_lossy: bool = False) -> DataFrame:
    """Lossless-first choice for PNG sources.

    ``attempts``: file_id, format_rank (0 png, 1 webp, 2 avif), output_bytes, decoded.
    The first format within the target wins. Without one, lossy search goes on if it is
    allowed; else the smallest lossless output is kept, not achieved.
    """
    # one size per format: fixed-width buffers, hashed and combined map-side
    formats = (
        attempts.filter(F.col("decoded"))
        .groupBy("file_id")
        .agg(*[F.min(F.when(F.col("format_rank") == i, F.col("output_bytes"))).alias(f"__{i}") for i in range(len(PNG_FORMATS))])
    )
    rows = files.select("file_id", "size_bytes", "requested_bytes").join(formats, "file_id", "left")
    sizes = [F.when(F.col(f"__{i}") < F.col("size_bytes"), F.col(f"__{i}")) for i in range(len(PNG_FORMATS))]
    first_fit = F.coalesce(
        *[F.when(size <= F.col("requested_bytes"), F.struct(F.lit(i).alias("format_rank"), size.alias("output_bytes"))) for i, size in enumerate(sizes)]
    )
    smallest = F.array_min(F.array(
        *[F.when(size.isNotNull(), F.struct(size.alias("output_bytes"), F.lit(i).alias("format_rank"))) for i, size in enumerate(sizes)]
    ))
    rows = rows.withColumns({"first_fit": first_fit, "smallest": smallest})
    original, target = F.col("size_bytes"), F.col("requested_bytes")
    no_work = target >= original
    outcome = (
        F.when(no_work, "no-reduction-needed")
        .when(F.col("first_fit").isNotNull(), "lossless-fits")
        .when(F.lit(allow_lossy), "lossy-search")
        .when(F.col("smallest").isNotNull(), "smallest-lossless")
        .otherwise("original-kept")
    )
    rows = rows.withColumn("outcome", outcome)
    pick_rank = F.when(F.col("outcome") == "lossless-fits", F.col("first_fit.format_rank")).when(
        F.col("outcome") == "smallest-lossless", F.col("smallest.format_rank")
    )
    pick_size = F.when(F.col("outcome") == "lossless-fits", F.col("first_fit.output_bytes")).when(
        F.col("outcome") == "smallest-lossless", F.col("smallest.output_bytes")
    )
    actual = F.coalesce(pick_size, original)
    return rows.select(
        "file_id",
        "outcome",
        F.get(F.array(*[F.lit(name) for name in PNG_FORMATS]), pick_rank).alias("selected_format"),
        actual.alias("actual_bytes"),
        (actual <= target).alias("achieved"),
    )


def target_report(
    selected: DataFrame, allow_resolution_change: bool = False, lossy_disabled: bool = False
) -> DataFrame:
    """Difference, saving and, for missed targets, what would help."""
    original, actual, target = (
        F.col(c) for c in ("original_bytes", "actual_bytes", "requested_bytes")
    )
    options = []
    if allow_resolution_change:
        options.append("lower-resolution")
    if not lossy_disabled:
        options.append("lower-quality-floor")
    options += ["keep-best-quality", "change-target"]
    achieved = actual <= target
    return selected.select(
        "file_id", "requested_bytes", "actual_bytes",
        (actual - target).alias("difference_bytes"),
        achieved.alias("achieved"),
        (original - actual).alias("saved_bytes"),
        saved_percent(original, actual, 0.0).alias("reduction_percent"),
        "attempts", "selected_quality", "selected_codec",
        F.when(~achieved, F.col("smallest_bytes")).alias("minimum_achievable_bytes"),
        F.when(~achieved, F.lit(",".join(options))).alias("alternatives"),
    )


def select_copy(copies: DataFrame, files: DataFrame, removals: DataFrame) -> DataFrame:
    """Accept a verified stream copy unless it grew and nothing was to be removed.

    ``copies``: file_id, output_bytes, verified. ``removals``: file_id rows with anything
    to remove (see ``removal_counts``).
    """
    wanted = removals.select("file_id").distinct().withColumn("__remove", F.lit(True))
    rows = files.join(copies, "file_id").join(wanted, "file_id", "left")
    removes = F.coalesce("__remove", F.lit(False))
    grew = F.col("output_bytes") > F.col("size_bytes")
    decision = (
        F.when(~F.col("verified"), "hash-mismatch")
        .when(grew & ~removes, "grew-without-removal")
        .when(grew, "removal-over-size")
        .otherwise("copied")
    )
    accepted = decision.isin("removal-over-size", "copied")
    output = F.when(accepted, F.col("output_bytes")).otherwise(F.col("size_bytes"))
    return rows.select(
        "file_id",
        decision.alias("decision"),
        (~accepted).alias("kept_original"),
        output.alias("output_bytes"),
        saved_percent(F.col("size_bytes"), output, 0.0).alias("reduction_percent"),
    )


def savings_rollup(results: DataFrame) -> DataFrame:
    """Saved bytes by kind and priority, by kind, and in total."""
    return (
        results.rollup("kind", "priority")
        .agg(
            F.grouping_id().cast("bigint").alias("level"),
            F.count(F.lit(1)).alias("files"),
            F.sum("original_bytes").alias("original_bytes"),
            F.sum("output_bytes").alias("output_bytes"),
        )
        .withColumn("saved_bytes", F.col("original_bytes") - F.col("output_bytes"))
        .withColumn(
            "reduction_percent", saved_percent(F.col("original_bytes"), F.col("output_bytes"), 0.0)
        )
    )


def codec_violations(items: DataFrame, formats: DataFrame) -> DataFrame:
    """Items whose codec the container does not take (container, stream, codec)."""
    return items.join(formats, ["container", "stream", "codec"], "left_anti")


def codec_allowed(items: DataFrame, formats: DataFrame) -> DataFrame:
    return items.join(formats, ["container", "stream", "codec"], "left_semi")


def enumerate_candidates(files: DataFrame, capabilities: DataFrame) -> DataFrame:
    """Every enabled codec and CRF step for every file, with encoder availability on its host.

    ``files``: file_id, host and, where known, include_av1, include_h265, include_h264 (null
    or missing: enabled), preset (an unknown one is ``medium``) and ffmpeg_available (null or
    missing: available). ``capabilities``: host, section, name. The host's encoders are folded
    to four flags first; the ladder is a constant array.
    """
    name = F.col("name")
    flags = (
        capabilities.filter(F.col("section") == "encoder")
        .groupBy("host")
        .agg(
            F.bool_or(name == "libsvtav1").alias("svt"),
            F.bool_or(name == "libaom-av1").alias("aom"),
            F.bool_or(name == "libx265").alias("x265"),
            F.bool_or(name == "libx264").alias("x264"),
        )
    )
    ladder = dims.struct_array(dims.CRF_LADDER, (("codec", "string"), ("crf", "int")))
    asked = files.select(
        "file_id", "host",
        *[_or_default(files, f"include_{c}", True).alias(f"__{c}") for c in dims.CODEC_LABELS],
        _or_default(files, "preset", dims.SEARCH_PRESETS[0]).alias("preset"),
        _or_default(files, "ffmpeg_available", True).alias("__ffmpeg"),
    )
    rows = asked.join(flags, "host", "left").select("*", F.inline(ladder))
    codec = F.col("codec")
    rows = rows.filter(
        F.when(codec == "av1", F.col("__av1")).when(codec == "h265", F.col("__h265")).otherwise(F.col("__h264"))
    )
    encoder = (
        F.when((codec == "av1") & F.col("svt"), "libsvtav1")
        .when(codec == "av1", "libaom-av1")
        .when(codec == "h265", "libx265")
        .otherwise("libx264")
    )
    available = (
        F.when((codec == "av1") & F.col("svt"), F.col("svt"))
        .when(codec == "av1", F.col("aom"))
        .when(codec == "h265", F.col("x265"))
        .otherwise(F.col("x264"))
    )
    usable = F.col("__ffmpeg") & F.coalesce(available, F.lit(False))
    return rows.select(
        "file_id",
        F.concat(codec, F.lit("-crf-"), F.col("crf")).alias("candidate_id"),
        F.concat(dims.lookup(codec, dims.CODEC_LABELS), F.lit(" CRF "), F.col("crf")).alias("label"),
        "codec", encoder.alias("encoder"), "crf",
        F.when(F.col("preset").isin(*dims.SEARCH_PRESETS), F.col("preset")).otherwise(dims.SEARCH_PRESETS[0]).alias("preset"),
        usable.alias("available"),
        F.when(~usable, F.concat(encoder, F.lit(dims.ENCODER_MISSING))).alias("unavailable_reason"),
    )
