"""Planning queries: targets, bitrates, resolutions, presets, estimates."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..plans import batches, bitrate, resolution
from ..sources.adapters import sql_fixed, sql_over, view
from . import register

PRESET_IDS = [p for p, _, _ in dims.TARGET_PRESETS]

PRESET_SQL = """
CASE file_id % 8 WHEN 0 THEN 10485760 WHEN 1 THEN 52428800 WHEN 2 THEN 5242880 WHEN 3 THEN 104857600
  WHEN 6 THEN 104857600 WHEN 7 THEN 26214400 END"""


def files(spark, sf_dir):
    return view(spark, sf_dir, "media_files")


def half_targets(spark, sf_dir):
    """Every file with the target of half its size."""
    asked = files(spark, sf_dir).withColumn("target_ratio", F.lit(0.5))
    return bitrate.accepted(bitrate.resolve_targets(asked))


def with_codec(df):
    pick = F.col("file_id") % 3
    return df.withColumn(
        "codec", F.when(pick == 0, "av1").when(pick == 1, "h265").otherwise("h264")
    )


# Plan of the half-size targets, shared by several checks.
PLAN_SQL = f"""
targets AS (
  SELECT *, CAST(greatest(1, floor(CAST(size_bytes AS DOUBLE) * 0.5e0)) AS BIGINT) AS requested_bytes
  FROM media_files WHERE size_bytes > 0
),
rates AS (
  SELECT *, CAST(requested_bytes AS DOUBLE) * 8 / duration_s / 1000 AS gross,
    CASE WHEN file_id % 3 = 0 THEN 'av1' WHEN file_id % 3 = 1 THEN 'h265' ELSE 'h264' END AS codec
  FROM targets WHERE duration_s > 0
),
usable AS (
  SELECT *, gross * 0.03e0 AS margin, gross * 0.015e0 AS overhead,
    greatest(0.0e0, gross - gross * 0.03e0 - gross * 0.015e0) AS usable,
    CASE WHEN audio_kbps > 0 AND audio_track_count > 0
         THEN CAST(audio_kbps AS DOUBLE) / audio_track_count ELSE 320.0e0 END AS per_track
  FROM rates
),
started AS (
  SELECT *, coalesce((SELECT max(s) FROM (VALUES (320),(256),(192),(128),(96),(64)) t(s) WHERE s <= per_track), 64) AS start_step
  FROM usable
),
stepped AS (
  SELECT *, CASE WHEN audio_track_count > 0 THEN
      coalesce((SELECT max(s) FROM (VALUES (320),(256),(192),(128),(96),(64)) t(s)
                WHERE s <= start_step AND usable - s * audio_track_count >= 180), 64) END AS step
  FROM started
),
plan AS (
  SELECT *, coalesce(step * audio_track_count, 0) AS audio_total,
    CAST(greatest(180, floor(usable - coalesce(step * audio_track_count, 0))) AS BIGINT) AS video_kbps,
    CASE WHEN kind = 'audio' THEN usable >= coalesce(step, 64)
         ELSE greatest(0.0e0, gross - margin - overhead - coalesce(step * audio_track_count, 0)) >= 180 END AS feasible
  FROM stepped
)"""


@register(
    "b1_resolve_targets",
    sql_over(
        ["media_files"],
        f"""
SELECT file_id,
  CAST(coalesce({PRESET_SQL}, greatest(1, floor(CAST(size_bytes AS DOUBLE) * CASE file_id % 8 WHEN 4 THEN 0.75e0 ELSE 0.5e0 END))) AS BIGINT) AS requested_bytes,
  coalesce({PRESET_SQL}, floor(CAST(size_bytes AS DOUBLE) * CASE file_id % 8 WHEN 4 THEN 0.75e0 ELSE 0.5e0 END)) < size_bytes AS needs_reduction
FROM media_files WHERE size_bytes > 0""",
    ),
)
def resolve_targets(spark, sf_dir):
    preset = F.element_at(dims.int_array(PRESET_IDS), (F.col("file_id") % 8 + 1).cast("int"))
    targets = bitrate.resolve_targets(files(spark, sf_dir), preset)
    return bitrate.accepted(targets).select("file_id", "requested_bytes", "needs_reduction")


@register(
    "b2_plan_bitrates",
    sql_over(
        ["media_files"],
        f"""WITH {PLAN_SQL.strip()}
SELECT file_id, {sql_fixed('gross', 1)} AS gross_kbps, {sql_fixed('usable', 1)} AS usable_kbps,
  {sql_fixed('margin', 1)} AS safety_margin_kbps, {sql_fixed('overhead', 1)} AS container_overhead_kbps,
  video_kbps, CAST(step AS INTEGER) AS audio_kbps_per_track, CAST(audio_total AS INTEGER) AS audio_kbps_total,
  CAST(audio_track_count AS INTEGER) AS track_count, audio_track_count = 0 AS remove_audio, feasible
FROM plan""",
    ),
)
def plan_bitrates(spark, sf_dir):
    return bitrate.plan_bitrates(half_targets(spark, sf_dir)).select(
        "file_id", "gross_kbps", "usable_kbps", "safety_margin_kbps", "container_overhead_kbps",
        "video_kbps", "audio_kbps_per_track", "audio_kbps_total", "track_count", "remove_audio",
        "feasible",
    )


@register(
    "b3_audio_step_census",
    sql_over(
        ["media_files"],
        f"""WITH {PLAN_SQL.strip()}
SELECT CAST(step AS INTEGER) AS audio_kbps_per_track, feasible, count(*) AS files,
  CAST(sum(video_kbps) AS BIGINT) AS video_kbps
FROM plan GROUP BY ALL""",
    ),
)
def audio_step_census(spark, sf_dir):
    plan = bitrate.plan_bitrates(half_targets(spark, sf_dir))
    return plan.groupBy("audio_kbps_per_track", "feasible").agg(
        F.count(F.lit(1)).alias("files"), F.sum("video_kbps").alias("video_kbps")
    )


@register(
    "j6_audio_candidates",
    sql_over(
        ["media_files"],
        """
WITH s AS (
  SELECT file_id,
    CASE WHEN audio_kbps > 0 AND audio_track_count > 0 THEN CAST(audio_kbps AS DOUBLE) / audio_track_count ELSE 320.0e0 END AS per_track,
    CASE WHEN file_id % 4 = 0 THEN 128 WHEN file_id % 4 = 1 THEN 100 WHEN file_id % 4 = 2 THEN 96 ELSE 64 END AS wanted
  FROM media_files WHERE audio_track_count > 0),
t AS (
  SELECT file_id, CASE WHEN wanted IN (320, 256, 192, 128, 96, 64) THEN wanted ELSE 64 END AS low,
    coalesce((SELECT max(s) FROM (VALUES (320),(256),(192),(128),(96),(64)) v(s) WHERE s <= per_track), 64) AS start
  FROM s)
SELECT file_id, CAST(v.s AS INTEGER) AS step_kbps FROM t JOIN (VALUES (320),(256),(192),(128),(96),(64)) v(s)
  ON (v.s <= start AND v.s >= low) OR (start < low AND v.s = low)""",
    ),
)
def audio_candidates(spark, sf_dir):
    pick = F.col("file_id") % 4
    asked = files(spark, sf_dir).filter("audio_track_count > 0").withColumn(
        "minimum_audio_kbps",
        F.when(pick == 0, 128).when(pick == 1, 100).when(pick == 2, 96).otherwise(64),
    )
    return bitrate.audio_candidates(asked)


@register(
    "b4_plan_audio",
    sql_over(
        ["media_files"],
        """
WITH t AS (
  SELECT *, CAST(greatest(1, floor(CAST(size_bytes AS DOUBLE) * 0.01e0)) AS BIGINT) AS requested_bytes
  FROM media_files WHERE kind = 'audio' AND duration_s > 0 AND size_bytes > 0),
u AS (
  SELECT *, CAST(requested_bytes AS DOUBLE) * 8 / duration_s / 1000 * (1 - 0.03e0 - 0.015e0) AS usable,
    greatest(1, audio_track_count) AS tracks,
    coalesce((SELECT max(s) FROM (VALUES (320),(256),(192),(128),(96),(64)) v(s)
      WHERE s <= CASE WHEN audio_kbps > 0 AND audio_track_count > 0 THEN CAST(audio_kbps AS DOUBLE) / audio_track_count ELSE 320.0e0 END), 64) AS start
  FROM t),
f AS (
  SELECT *, (SELECT max(s) FROM (VALUES (320),(256),(192),(128),(96),(64)) v(s) WHERE s <= start AND s * tracks <= usable) AS step FROM u)
SELECT file_id, requested_bytes,
  CASE WHEN size_bytes <= requested_bytes THEN 'already-within-target' WHEN step IS NULL THEN 'unreachable' ELSE 'planned' END AS outcome,
  CAST(CASE WHEN size_bytes > requested_bytes THEN step END AS INTEGER) AS step_kbps,
  CAST(CASE WHEN size_bytes > requested_bytes AND step IS NULL THEN ceil(64 * tracks * 1000 * duration_s / 8) END AS BIGINT) AS minimum_bytes
FROM f""",
    ),
)
def plan_audio(spark, sf_dir):
    asked = files(spark, sf_dir).withColumn("target_ratio", F.lit(0.01))
    targets = bitrate.accepted(bitrate.resolve_targets(asked))
    return bitrate.plan_audio(targets).select(
        "file_id", "requested_bytes", "outcome", "step_kbps", "minimum_bytes"
    )


CANDIDATE_SQL = """
cands AS (
  SELECT f.file_id, f.codec, f.width, f.height, f.fps, h.h AS candidate
  FROM (SELECT *, CASE WHEN file_id % 3 = 0 THEN 'av1' WHEN file_id % 3 = 1 THEN 'h265' ELSE 'h264' END AS codec
        FROM media_files WHERE kind = 'video') f
  JOIN (VALUES (2160),(1440),(1080),(720),(480)) h(h) ON h.h < f.height AND h.h >= 480
  UNION ALL
  SELECT file_id, CASE WHEN file_id % 3 = 0 THEN 'av1' WHEN file_id % 3 = 1 THEN 'h265' ELSE 'h264' END, width, height, fps, height
  FROM media_files WHERE kind = 'video'),
rated AS (
  SELECT *, CAST(floor(CASE WHEN candidate >= 2160 THEN 12000 WHEN candidate >= 1440 THEN 7000 WHEN candidate >= 1080 THEN 4000
                  WHEN candidate >= 720 THEN 2000 ELSE 900 END
      * CASE codec WHEN 'av1' THEN 0.48e0 WHEN 'h265' THEN 0.62e0 ELSE 1.0e0 END
      * least(2.0e0, greatest(0.75e0, coalesce(fps, 30.0e0) / 30)) + 0.5e0) AS BIGINT) AS minimum_kbps,
    CAST(greatest(2, floor(CAST(width AS DOUBLE) * candidate / height / 2 + 0.5e0) * 2) AS BIGINT) AS candidate_width
  FROM cands)"""


@register(
    "j5_resolution_candidates",
    sql_over(
        ["media_files"],
        f"""WITH {CANDIDATE_SQL.strip()}
SELECT file_id, CAST(candidate AS INTEGER) AS candidate_height, candidate_width, minimum_kbps,
  candidate = height AS is_source FROM rated""",
    ),
)
def resolution_candidates(spark, sf_dir):
    videos = with_codec(files(spark, sf_dir).filter("kind = 'video'"))
    return resolution.resolution_candidates(videos)


def video_plan(spark, sf_dir):
    plan = bitrate.plan_bitrates(half_targets(spark, sf_dir).filter("kind = 'video'"))
    return with_codec(plan)


@register(
    "b5_recommend_resolution",
    sql_over(
        ["media_files"],
        f"""WITH {PLAN_SQL.strip()},
{CANDIDATE_SQL.strip()},
j AS (
  SELECT p.file_id, p.height, p.video_kbps, r.candidate, r.minimum_kbps
  FROM plan p JOIN rated r ON p.file_id = r.file_id),
r AS (
  SELECT file_id, any_value(height) AS height,
    bool_or(candidate = height AND video_kbps >= minimum_kbps) AS sustainable,
    max(CASE WHEN candidate < height AND video_kbps >= minimum_kbps THEN candidate END) AS fit,
    min(CASE WHEN candidate < height THEN candidate END) AS lowest
  FROM j GROUP BY file_id)
SELECT file_id, sustainable AS source_sustainable,
  CAST(CASE WHEN NOT sustainable THEN coalesce(fit, lowest) END AS INTEGER) AS recommended_height,
  CAST(coalesce(CASE WHEN NOT sustainable THEN coalesce(fit, lowest) END, height) AS INTEGER) AS selected_height,
  coalesce(CASE WHEN NOT sustainable THEN coalesce(fit, lowest) END, height) < height AS will_change
FROM r""",
    ),
)
def recommend_resolution(spark, sf_dir):
    return resolution.recommend_resolution(video_plan(spark, sf_dir)).select(
        "file_id", "source_sustainable", "recommended_height", "selected_height", "will_change"
    )


BAND_SQL = """
CASE WHEN requested_bytes >= size_bytes THEN 'achievable'
     WHEN requested_bytes >= minimum_bytes AND reduction <= 0.35e0 THEN 'achievable'
     WHEN requested_bytes >= minimum_bytes AND reduction <= 0.65e0 THEN 'settings-recommended'
     WHEN requested_bytes >= minimum_bytes OR requested_bytes >= minimum_bytes * 0.85e0 THEN 'quality-risk'
     ELSE 'difficult' END AS feasibility,
CASE WHEN requested_bytes >= size_bytes THEN 'none'
     WHEN requested_bytes >= minimum_bytes AND reduction <= 0.35e0 THEN 'small'
     WHEN requested_bytes >= minimum_bytes AND reduction <= 0.65e0 THEN 'moderate'
     ELSE 'large' END AS quality_impact"""


@register(
    "b6_feasibility",
    sql_over(
        ["media_files"],
        f"""WITH {PLAN_SQL.strip()},
m AS (
  SELECT *, CAST(ceil((180 + audio_total) * 1000 * duration_s / 8) AS BIGINT) AS minimum_bytes,
    greatest(0.0e0, 1 - CAST(requested_bytes AS DOUBLE) / greatest(1, size_bytes)) AS reduction
  FROM plan),
b AS (SELECT *, greatest(1, greatest(requested_bytes, minimum_bytes)) AS estimated_output_bytes FROM m)
SELECT file_id, minimum_bytes, {BAND_SQL}, CAST(estimated_output_bytes AS BIGINT) AS estimated_output_bytes,
  {sql_fixed('(CAST(size_bytes - estimated_output_bytes AS DOUBLE) / CAST(size_bytes AS DOUBLE) * 100)', 1)} AS estimated_reduction_percent
FROM b""",
    ),
)
def feasibility(spark, sf_dir):
    plan = bitrate.minimum_bytes(bitrate.plan_bitrates(half_targets(spark, sf_dir)))
    return bitrate.feasibility(plan).select(
        "file_id", "minimum_bytes", "feasibility", "quality_impact", "estimated_output_bytes",
        "estimated_reduction_percent",
    )


ANALYSIS_SQL = """
analysis AS (
  SELECT batch_id, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS total_bytes,
    array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds,
    CAST(nullif(max(greatest(coalesce(width, 0), coalesce(height, 0))), 0) AS INTEGER) AS max_long_edge,
    nullif(max(coalesce(duration_s, 0.0e0)), 0.0e0) AS max_duration_s,
    bool_or(has_alpha) AS has_transparency
  FROM media_files GROUP BY batch_id)"""

USE_CASE_SQL = """CASE WHEN (kinds LIKE '%video%' OR kinds LIKE '%audio%') AND total_bytes > 20971520 THEN 'smartphone'
  WHEN kinds LIKE '%video%' OR kinds LIKE '%audio%' THEN 'social'
  WHEN coalesce(max_long_edge, 0) >= 4000 AND total_bytes < 12582912 THEN 'print' ELSE 'web' END AS use_case"""


@register("a2_analyze_batches", sql_over(["media_files"], f"WITH {ANALYSIS_SQL.strip()} SELECT * FROM analysis"))
def analyze_batches(spark, sf_dir):
    return batches.analyze_batches(files(spark, sf_dir))


@register(
    "b7_recommend_use_case",
    sql_over(["media_files"], f"WITH {ANALYSIS_SQL.strip()} SELECT batch_id, {USE_CASE_SQL} FROM analysis"),
)
def recommend_use_case(spark, sf_dir):
    analysed = batches.analyze_batches(files(spark, sf_dir))
    return batches.recommend_use_case(analysed).select("batch_id", "use_case")


@register(
    "b8_sample_windows",
    sql_over(
        ["media_files"],
        f"""WITH w AS (SELECT file_id, duration_s, least(3.0e0, duration_s) AS window_s FROM media_files WHERE duration_s > 0),
s AS (SELECT file_id, window_s, 0.0e0 AS start_s FROM w
  UNION SELECT file_id, window_s, {sql_fixed('greatest(0.0e0, duration_s / 2 - window_s / 2)', 3)} FROM w
  UNION SELECT file_id, window_s, {sql_fixed('greatest(0.0e0, duration_s - window_s)', 3)} FROM w)
SELECT * FROM s""",
    ),
)
def sample_windows(spark, sf_dir):
    return bitrate.sample_windows(files(spark, sf_dir))


@register(
    "b9_minimum_bytes",
    sql_over(
        ["media_files"],
        f"""WITH {PLAN_SQL.strip()}
SELECT file_id, CAST(ceil((180 + audio_total) * 1000 * duration_s / 8) AS BIGINT) AS minimum_bytes
FROM plan WHERE NOT feasible""",
    ),
)
def minimum_bytes(spark, sf_dir):
    plan = bitrate.plan_bitrates(half_targets(spark, sf_dir)).filter(~F.col("feasible"))
    return bitrate.minimum_bytes(plan).select("file_id", "minimum_bytes")


def _preset_values() -> str:
    def text(v):
        return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v!r}e0" if isinstance(v, float) else str(v)

    return ",\n".join(f"({', '.join(text(v) for v in row)})" for row in dims.USE_CASE_PRESETS)


@register(
    "j7_resolve_presets",
    sql_over(
        ["media_files"],
        f"""WITH {ANALYSIS_SQL.strip()},
p(preset_id, low, high, spm, photo, transparent, enc, edge, image_mb, many_mb, media_mb, mode, speed) AS (VALUES
{_preset_values()}),
x AS (SELECT *, CAST(CASE WHEN kinds = 'image' AND files = 1 THEN image_mb WHEN kinds = 'image' THEN many_mb ELSE media_mb END AS BIGINT) * 1048576 AS target
  FROM analysis, p),
y AS (SELECT *, coalesce(total_bytes > target, false) AS needs, coalesce(max_long_edge > edge, false) AS shrinks,
    CASE WHEN has_transparency THEN transparent ELSE photo END AS image_format FROM x),
z AS (SELECT *, CAST(floor(least(90.0e0, greatest(CAST(low AS DOUBLE), CAST(low + high AS DOUBLE) / 2 + CASE WHEN shrinks THEN 8 ELSE 0 END,
    CASE WHEN needs THEN (1 - CAST(target AS DOUBLE) / CAST(total_bytes AS DOUBLE)) * 100 ELSE 0.0e0 END)) + 0.5e0) AS BIGINT) AS pct FROM y)
SELECT batch_id, preset_id, target AS target_bytes, needs AS needs_target, pct AS reduction_percent,
  CAST(least(total_bytes, floor(total_bytes * (1 - CAST(pct AS DOUBLE) / 100) + 0.5e0)) AS BIGINT) AS estimated_output_bytes,
  CAST(greatest(2, floor(CAST(total_bytes AS DOUBLE) / 1048576 * spm + coalesce(max_duration_s, 0.0e0) * 0.18e0 + 0.5e0)) AS BIGINT) AS estimated_seconds,
  CASE WHEN needs THEN greatest(0.01e0, least(0.99e0, CAST(target AS DOUBLE) / CAST(total_bytes AS DOUBLE))) ELSE 0.5e0 END AS target_ratio,
  CASE WHEN needs THEN 'target-size' ELSE mode END AS processing_mode, image_format,
  CASE WHEN image_format IN ('png', 'tiff') OR enc = 'lossless' THEN 'lossless' ELSE enc END AS image_encoding,
  CAST(CASE WHEN shrinks THEN edge END AS INTEGER) AS image_long_edge, speed AS speed_preset
FROM z""",
    ),
)
def resolve_presets(spark, sf_dir):
    return batches.resolve_presets(batches.analyze_batches(files(spark, sf_dir)))


@register(
    "a3_estimate_batches",
    sql_over(
        ["media_files"],
        f"""
WITH g AS (
  SELECT batch_id, CAST(sum(size_bytes) AS BIGINT) AS size_bytes, bool_or(kind = 'video') AS hv, bool_or(kind = 'audio') AS ha,
    arg_min(height, file_id) FILTER (kind = 'video') AS vh, arg_min(duration_s, file_id) FILTER (kind = 'video') AS vd,
    arg_min(duration_s, file_id) FILTER (kind = 'audio') AS ad
  FROM media_files GROUP BY batch_id),
t AS (SELECT *, CAST(greatest(1, floor(CAST(size_bytes AS DOUBLE) * 0.3e0)) AS BIGINT) AS requested_bytes,
  CAST(greatest(1, floor(size_bytes * CASE WHEN hv THEN 0.18e0 WHEN ha THEN 0.22e0 ELSE 0.08e0 END + 0.5e0)) AS BIGINT) AS minimum_bytes FROM g),
u AS (SELECT *, CAST(requested_bytes AS DOUBLE) / CAST(size_bytes AS DOUBLE) AS ratio,
  greatest(0.0e0, 1 - CAST(requested_bytes AS DOUBLE) / greatest(1, size_bytes)) AS reduction,
  CAST(CASE WHEN requested_bytes >= size_bytes THEN size_bytes ELSE greatest(requested_bytes, minimum_bytes) END AS BIGINT) AS est FROM t),
v AS (SELECT *, CAST(floor(size_bytes * least(1.0e0, CAST(est AS DOUBLE) / CAST(size_bytes AS DOUBLE)) + 0.5e0) AS BIGINT) AS out FROM u)
SELECT batch_id, size_bytes AS input_bytes, requested_bytes AS target_bytes, minimum_bytes,
  CAST(CASE WHEN vh IS NOT NULL THEN least(vh, CASE WHEN ratio >= 0.55e0 THEN vh WHEN ratio >= 0.35e0 THEN 1080 WHEN ratio >= 0.2e0 THEN 720 ELSE 480 END) END AS INTEGER) AS recommended_height,
  {BAND_SQL},
  CAST(CASE WHEN hv THEN greatest(5, floor(coalesce(vd, 5.0e0) * 2.2e0 + 0.5e0)) WHEN ha THEN greatest(2, floor(coalesce(ad, 2.0e0) * 0.35e0 + 0.5e0)) ELSE 11 END AS BIGINT) AS estimated_seconds,
  out AS output_bytes, greatest(0, size_bytes - out) AS saved_bytes
FROM v""",
    ),
)
def estimate_batches(spark, sf_dir):
    return batches.estimate_batches(files(spark, sf_dir), target_ratio=0.3)


@register(
    "a4_estimate_from_samples",
    sql_over(
        ["media_files", "size_samples"],
        f"""
WITH s AS (SELECT file_id, CAST(sum(duration_s) AS DOUBLE) AS ss, CAST(sum(output_bytes) AS DOUBLE) AS sb,
    CAST(sum(CAST(CAST(processing_ds AS DOUBLE) / 10 AS DECIMAL(28, 6))) AS DOUBLE) AS sp, count(*) AS samples
  FROM size_samples GROUP BY file_id),
j AS (SELECT m.*, s.ss, s.sb, s.sp, s.samples, CAST(greatest(1, floor(CAST(size_bytes AS DOUBLE) * 0.01e0)) AS BIGINT) AS requested,
    CAST(greatest(1, floor(sb / ss * m.duration_s + 0.5e0)) AS BIGINT) AS est
  FROM media_files m JOIN s ON m.file_id = s.file_id WHERE m.duration_s > 0 AND m.size_bytes > 0 AND ss > 0),
r AS (SELECT *, CAST(est AS DOUBLE) / CAST(requested AS DOUBLE) AS ratio FROM j)
SELECT file_id, samples, est AS estimated_output_bytes,
  {sql_fixed('(CAST(size_bytes - est AS DOUBLE) / CAST(size_bytes AS DOUBLE) * 100)', 1)} AS estimated_reduction_percent,
  CAST(greatest(1, floor(CASE WHEN sp / ss > 0 THEN sp / ss * duration_s ELSE duration_s END + 0.5e0)) AS BIGINT) AS estimated_seconds,
  CASE WHEN ratio <= 0.85e0 THEN 'small' WHEN ratio <= 1.05e0 THEN 'moderate' ELSE 'large' END AS quality_impact,
  CASE WHEN ratio <= 1 THEN 'achievable' WHEN ratio <= 1.1e0 THEN 'settings-recommended' ELSE 'difficult' END AS feasibility
FROM r""",
    ),
)
def estimate_from_samples(spark, sf_dir):
    asked = files(spark, sf_dir).withColumn("target_ratio", F.lit(0.01))
    targets = bitrate.accepted(bitrate.resolve_targets(asked))
    samples = view(spark, sf_dir, "size_samples").withColumn(
        "processing_s", F.col("processing_ds") / 10
    )
    return batches.estimate_from_samples(samples, targets).select(
        "file_id", "samples", "estimated_output_bytes", "estimated_reduction_percent",
        "estimated_seconds", "quality_impact", "feasibility",
    )
