"""Queries that choose among measured attempts and judge quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..operators import quality as quality_ops
from ..operators import selection as ops
from ..plans import bitrate
from ..sources.adapters import sql_fixed, sql_over, table, view
from . import register


def attempts(spark, sf_dir):
    return view(spark, sf_dir, "encode_attempts")


def files(spark, sf_dir):
    return view(spark, sf_dir, "media_files")


def half_targets(spark, sf_dir):
    asked = files(spark, sf_dir).withColumn("target_ratio", F.lit(0.5))
    key = F.col("file_id")
    return bitrate.accepted(bitrate.resolve_targets(asked)).select(
        "file_id", "size_bytes", "requested_bytes",
        F.when(key % 3 == 0, "jpeg").when(key % 3 == 1, "webp").otherwise("avif").alias("output_format"),
        F.when(key % 11 == 0, 70).alias("quality_floor"),
    )


def _percent(original: str, output: str) -> str:
    value = sql_fixed(f"(CAST({original} - {output} AS DOUBLE) / CAST({original} AS DOUBLE) * 100)", 1)
    return f"CASE WHEN {original} > 0 AND {output} >= 0 THEN {value} ELSE 0.0e0 END"


@register(
    "t1_select_lossless",
    sql_over(
        ["media_files", "encode_attempts"],
        f"""WITH f AS (SELECT file_id, size_bytes, file_id % 3 <> 0 AS strip, file_id % 2 = 0 AS has FROM media_files),
r AS (SELECT file_id, ordinal, output_bytes, row_number() OVER (PARTITION BY file_id ORDER BY output_bytes, ordinal, tie_a, tie_b) AS rn,
    count(*) OVER (PARTITION BY file_id) AS n FROM encode_attempts WHERE decoded AND tie_a % 5 <> 0),
j AS (SELECT f.*, r.ordinal, r.output_bytes AS best, coalesce(r.n, 0) AS n, coalesce(r.output_bytes < size_bytes, false) AS better, NOT strip OR NOT has AS ok
  FROM f LEFT JOIN r ON r.file_id = f.file_id AND r.rn = 1),
k AS (SELECT *, CASE WHEN better THEN best ELSE size_bytes END AS output_bytes FROM j)
SELECT file_id, CAST(CASE WHEN better THEN ordinal END AS INTEGER) AS selected_ordinal, output_bytes, NOT better AS kept_original,
  CASE WHEN better AND ok THEN 'smaller-verified' WHEN better THEN 'smaller-verified-privacy' WHEN NOT ok THEN 'privacy-not-removed'
    WHEN n > 0 THEN 'verified-not-smaller' ELSE 'no-verified-candidate' END AS reason,
  {_percent('size_bytes', 'output_bytes')} AS reduction_percent
FROM k""",
    ),
)
def select_lossless(spark, sf_dir):
    catalog = files(spark, sf_dir).select(
        "file_id", "size_bytes",
        (F.col("file_id") % 3 != 0).alias("strip_privacy"),
        (F.col("file_id") % 2 == 0).alias("has_privacy"),
    )
    candidates = attempts(spark, sf_dir).withColumns(
        {"eligible": F.col("decoded"), "verified": F.col("tie_a") % 5 != 0}
    )
    return ops.select_lossless(candidates, catalog)


QUALITY_SQL = """
best AS (SELECT file_id, ordinal, output_bytes, codec, row_number() OVER (PARTITION BY file_id ORDER BY output_bytes, ordinal, tie_a, tie_b, codec) AS rn
  FROM encode_attempts WHERE decoded AND vmaf_mean >= 95 AND vmaf_min >= 80),
chosen AS (SELECT m.*, b.ordinal, b.codec, b.output_bytes AS best, coalesce(b.output_bytes < m.size_bytes, false) AS better, b.file_id IS NOT NULL AS any_qualified
  FROM media_files m LEFT JOIN best b ON b.file_id = m.file_id AND b.rn = 1),
decided AS (SELECT *, CASE WHEN better THEN best ELSE size_bytes END AS output_bytes,
  CASE WHEN better THEN 'qualified' WHEN any_qualified THEN 'not-smaller' ELSE 'none-qualified' END AS decision FROM chosen)"""


@register(
    "t2_select_quality",
    sql_over(
        ["media_files", "encode_attempts"],
        f"""WITH {QUALITY_SQL.strip()}
SELECT file_id, size_bytes AS original_bytes, output_bytes, CASE WHEN better THEN codec END AS selected_codec,
  CAST(CASE WHEN better THEN ordinal END AS INTEGER) AS selected_ordinal, NOT better AS kept_original, decision,
  {_percent('size_bytes', 'output_bytes')} AS reduction_percent FROM decided""",
    ),
)
def select_quality(spark, sf_dir):
    return ops.select_quality(attempts(spark, sf_dir), files(spark, sf_dir))


@register(
    "t2_thresholds_per_file",
    sql_over(
        ["encode_attempts"],
        """WITH c AS (SELECT *, CASE WHEN file_id % 4 = 0 THEN 90.0e0 WHEN file_id % 4 = 1 THEN 97.0e0 ELSE 95.0e0 END AS mt, CASE WHEN file_id % 5 = 0 THEN 60.0e0 ELSE 80.0e0 END AS ft FROM encode_attempts)
SELECT file_id, count(*) FILTER (decoded AND vmaf_mean >= mt AND vmaf_min >= ft) AS qualified, count(*) FILTER (NOT decoded) AS unavailable, count(*) AS candidates FROM c GROUP BY file_id""",
    ),
)
def thresholds_per_file(spark, sf_dir):
    key = F.col("file_id")
    own = attempts(spark, sf_dir).withColumns({
        "mean_threshold": F.when(key % 4 == 0, 90.0).when(key % 4 == 1, 97.0), "frame_threshold": F.when(key % 5 == 0, 60.0),
    })
    state = F.col("gate")
    return ops.gate(own).groupBy("file_id").agg(
        F.count_if(state == "qualified").alias("qualified"), F.count_if(state == "unavailable").alias("unavailable"),
        F.count(F.lit(1)).alias("candidates"),
    )


@register(
    "a11_candidate_tally",
    sql_over(
        ["encode_attempts"],
        """SELECT codec, CASE WHEN NOT decoded THEN 'unavailable' WHEN vmaf_mean >= 95 AND vmaf_min >= 80 THEN 'qualified' ELSE 'rejected' END AS gate,
  count(*) AS candidates, CAST(sum(output_bytes) AS BIGINT) AS output_bytes FROM encode_attempts GROUP BY ALL""",
    ),
)
def candidate_tally(spark, sf_dir):
    return ops.candidate_tally(attempts(spark, sf_dir))


@register(
    "a11_report_tally",
    sql_over(
        ["media_files", "encode_attempts"],
        f"""WITH {QUALITY_SQL.strip()},
m AS (SELECT *, CASE file_id % 4 WHEN 0 THEN 'strict-lossless' WHEN 1 THEN 'high-quality-optimization' WHEN 2 THEN 'size-priority' ELSE 'archive' END AS mode FROM decided),
c AS (SELECT m.mode, a.codec, a.output_bytes, CASE WHEN NOT a.decoded THEN 'unavailable' WHEN a.vmaf_mean >= 95 AND a.vmaf_min >= 80 THEN 'qualified' ELSE 'rejected' END AS gate,
    m.better AND a.decoded AND row_number() OVER (PARTITION BY a.file_id, a.decoded AND a.vmaf_mean >= 95 AND a.vmaf_min >= 80 ORDER BY a.output_bytes, a.ordinal, a.tie_a, a.tie_b, a.codec) = 1 AS first
  FROM encode_attempts a LEFT JOIN m USING (file_id))
SELECT mode, codec, CASE WHEN gate = 'qualified' AND first THEN 'selected' ELSE gate END AS status, count(*) AS candidates, CAST(coalesce(sum(output_bytes), 0) AS BIGINT) AS output_bytes FROM c GROUP BY ALL""",
    ),
)
def report_tally(spark, sf_dir):
    modes = F.element_at(F.array(*[F.lit(m) for m in dims.OPTIMIZATION_MODES]), (F.col("file_id") % 4 + 1).cast("int"))
    return ops.report_tally(attempts(spark, sf_dir), files(spark, sf_dir).withColumn("mode", modes))


@register(
    "a11_decision_tally",
    sql_over(
        ["media_files", "encode_attempts"],
        f"""WITH {QUALITY_SQL.strip()}
SELECT decision, count(*) AS files, count(*) FILTER (NOT better) AS kept_files,
  {sql_fixed('(CAST(count(*) FILTER (NOT better) AS DOUBLE) / (SELECT count(*) FROM decided) * 100)', 1)} AS kept_percent
FROM decided GROUP BY decision""",
    ),
)
def decision_tally(spark, sf_dir):
    return ops.decision_tally(ops.select_quality(attempts(spark, sf_dir), files(spark, sf_dir)))


@register(
    "a12_savings_rollup",
    sql_over(
        ["media_files", "encode_attempts"],
        f"""WITH {QUALITY_SQL.strip()},
g AS (SELECT kind, priority, CAST(GROUPING(kind, priority) AS BIGINT) AS level, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS original_bytes,
  CAST(sum(output_bytes) AS BIGINT) AS output_bytes FROM decided GROUP BY ROLLUP (kind, priority))
SELECT *, original_bytes - output_bytes AS saved_bytes, {_percent('original_bytes', 'output_bytes')} AS reduction_percent FROM g""",
    ),
)
def savings_rollup(spark, sf_dir):
    catalog = files(spark, sf_dir)
    chosen = ops.select_quality(attempts(spark, sf_dir), catalog)
    return ops.savings_rollup(chosen.join(catalog.select("file_id", "kind", "priority"), "file_id"))


TARGET_SQL = """
targets AS (SELECT file_id, size_bytes, CAST(greatest(1, floor(CAST(size_bytes AS DOUBLE) * 0.5e0)) AS BIGINT) AS requested_bytes,
    CASE WHEN file_id % 11 = 0 THEN 70 WHEN file_id % 3 = 0 THEN 60 WHEN file_id % 3 = 1 THEN 55 ELSE 45 END AS floor_quality
  FROM media_files WHERE size_bytes > 0),
usable AS (SELECT a.*, t.size_bytes, t.requested_bytes, a.output_bytes <= t.requested_bytes AND a.output_bytes < t.size_bytes AS fits
  FROM encode_attempts a JOIN targets t USING (file_id) WHERE decoded AND quality >= floor_quality),
best AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY quality DESC, output_bytes, ordinal, tie_a, tie_b, codec) AS rn FROM usable WHERE fits),
low AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY quality, output_bytes, ordinal, tie_a, tie_b, codec) AS rn FROM usable JOIN (SELECT file_id AS floor_file, floor_quality FROM targets) ON file_id = floor_file WHERE quality = floor_quality),
tally AS (SELECT file_id, count(*) AS attempts, min(CASE WHEN output_bytes < size_bytes THEN output_bytes END) AS smallest FROM usable GROUP BY file_id),
joined AS (SELECT t.file_id, t.size_bytes, t.requested_bytes, t.requested_bytes >= t.size_bytes AS no_work, b.file_id IS NOT NULL AS has_best,
    coalesce(l.output_bytes < t.size_bytes, false) AS low_kept, b.output_bytes AS bb, b.quality AS bq, b.codec AS bc, l.output_bytes AS lb, l.quality AS lq, l.codec AS lc,
    coalesce(y.attempts, 0) AS attempts, least(t.size_bytes, coalesce(y.smallest, t.size_bytes)) AS smallest
  FROM targets t LEFT JOIN best b ON b.file_id = t.file_id AND b.rn = 1 LEFT JOIN low l ON l.file_id = t.file_id AND l.rn = 1 LEFT JOIN tally y ON y.file_id = t.file_id),
chosen AS (SELECT file_id, size_bytes AS original_bytes, requested_bytes,
    CASE WHEN no_work THEN size_bytes WHEN has_best THEN bb WHEN low_kept THEN lb ELSE size_bytes END AS actual_bytes,
    CAST(CASE WHEN no_work THEN NULL WHEN has_best THEN bq WHEN low_kept THEN lq END AS INTEGER) AS selected_quality,
    CASE WHEN no_work THEN NULL WHEN has_best THEN bc WHEN low_kept THEN lc END AS selected_codec, attempts, smallest AS smallest_bytes,
    CASE WHEN no_work THEN 'no-reduction-needed' WHEN has_best THEN 'fits' WHEN low_kept THEN 'floor-misses-target' ELSE 'original-kept' END AS outcome
  FROM joined)"""


@register(
    "t3_select_for_target",
    sql_over(
        ["media_files", "encode_attempts"],
        f"""WITH {TARGET_SQL.strip()}
SELECT file_id, original_bytes, requested_bytes, actual_bytes, selected_quality, selected_codec, attempts, smallest_bytes, outcome,
  actual_bytes <= requested_bytes AS achieved FROM chosen""",
    ),
)
def select_for_target(spark, sf_dir):
    chosen = ops.select_for_target(attempts(spark, sf_dir), half_targets(spark, sf_dir))
    return chosen.drop("within_tolerance")


@register(
    "t5_tolerance_band",
    sql_over(
        ["media_files", "encode_attempts"],
        f"""WITH {TARGET_SQL.strip()}
SELECT file_id, actual_bytes <= requested_bytes AND requested_bytes - actual_bytes <= greatest(1, CAST(floor(requested_bytes * 0.02e0) AS BIGINT)) AS within_tolerance FROM chosen""",
    ),
)
def tolerance_band(spark, sf_dir):
    chosen = ops.select_for_target(attempts(spark, sf_dir), half_targets(spark, sf_dir))
    return chosen.select("file_id", "within_tolerance")


@register(
    "t6_target_report",
    sql_over(
        ["media_files", "encode_attempts"],
        f"""WITH {TARGET_SQL.strip()}
SELECT file_id, requested_bytes, actual_bytes, actual_bytes - requested_bytes AS difference_bytes, actual_bytes <= requested_bytes AS achieved,
  original_bytes - actual_bytes AS saved_bytes, {_percent('original_bytes', 'actual_bytes')} AS reduction_percent, attempts, selected_quality, selected_codec,
  CASE WHEN actual_bytes > requested_bytes THEN smallest_bytes END AS minimum_achievable_bytes,
  CASE WHEN actual_bytes > requested_bytes THEN 'lower-resolution,lower-quality-floor,keep-best-quality,change-target' END AS alternatives
FROM chosen""",
    ),
)
def target_report(spark, sf_dir):
    chosen = ops.select_for_target(attempts(spark, sf_dir), half_targets(spark, sf_dir))
    return ops.target_report(chosen, allow_resolution_change=True)


@register(
    "t4_select_png",
    sql_over(
        ["media_files", "encode_attempts"],
        """WITH t AS (SELECT file_id, size_bytes, CAST(greatest(1, floor(CAST(size_bytes AS DOUBLE) * 0.2e0)) AS BIGINT) AS requested_bytes FROM media_files WHERE size_bytes > 0),
a AS (SELECT file_id, CASE codec WHEN 'h264' THEN 0 WHEN 'h265' THEN 1 ELSE 2 END AS rank, min(output_bytes) AS bytes FROM encode_attempts WHERE decoded GROUP BY ALL),
j AS (SELECT t.*, a.rank, a.bytes, a.bytes < size_bytes AS smaller, a.bytes < size_bytes AND a.bytes <= requested_bytes AS fits FROM t LEFT JOIN a USING (file_id)),
g AS (SELECT file_id, any_value(size_bytes) AS size_bytes, any_value(requested_bytes) AS requested_bytes, min(CASE WHEN fits THEN rank END) AS fr, arg_min(CASE WHEN fits THEN bytes END, CASE WHEN fits THEN rank END) AS fb,
    arg_min(CASE WHEN smaller THEN rank END, CASE WHEN smaller THEN bytes * 10 + rank END) AS sr, min(CASE WHEN smaller THEN bytes END) AS sb FROM j GROUP BY file_id),
o AS (SELECT *, CASE WHEN requested_bytes >= size_bytes THEN 'no-reduction-needed' WHEN fr IS NOT NULL THEN 'lossless-fits' WHEN sb IS NOT NULL THEN 'smallest-lossless' ELSE 'original-kept' END AS outcome FROM g),
p AS (SELECT *, CASE outcome WHEN 'lossless-fits' THEN fr WHEN 'smallest-lossless' THEN sr END AS rank, coalesce(CASE outcome WHEN 'lossless-fits' THEN fb WHEN 'smallest-lossless' THEN sb END, size_bytes) AS actual_bytes FROM o)
SELECT file_id, outcome, CASE rank WHEN 0 THEN 'png' WHEN 1 THEN 'webp' WHEN 2 THEN 'avif' END AS selected_format, actual_bytes, actual_bytes <= requested_bytes AS achieved FROM p""",
    ),
)
def select_png(spark, sf_dir):
    asked = files(spark, sf_dir).withColumn("target_ratio", F.lit(0.2))
    targets = bitrate.accepted(bitrate.resolve_targets(asked))
    codec = F.col("codec")
    ranked = attempts(spark, sf_dir).withColumn(
        "format_rank", F.when(codec == "h264", 0).when(codec == "h265", 1).otherwise(2)
    )
    return ops.select_png(ranked, targets)


@register(
    "t7_select_copy",
    sql_over(
        ["media_files", "encode_attempts"],
        f"""WITH c AS (SELECT file_id, max(output_bytes) AS output_bytes, bool_and(decoded) AS verified FROM encode_attempts GROUP BY file_id),
j AS (SELECT m.file_id, m.size_bytes, c.output_bytes AS copied, c.verified, m.file_id % 3 = 0 AS removes FROM media_files m JOIN c USING (file_id)),
d AS (SELECT *, CASE WHEN NOT verified THEN 'hash-mismatch' WHEN copied > size_bytes AND NOT removes THEN 'grew-without-removal' WHEN copied > size_bytes THEN 'removal-over-size' ELSE 'copied' END AS decision FROM j),
e AS (SELECT *, CASE WHEN decision IN ('removal-over-size', 'copied') THEN copied ELSE size_bytes END AS output_bytes FROM d)
SELECT file_id, decision, decision NOT IN ('removal-over-size', 'copied') AS kept_original, output_bytes, {_percent('size_bytes', 'output_bytes')} AS reduction_percent FROM e""",
    ),
)
def select_copy(spark, sf_dir):
    copies = attempts(spark, sf_dir).groupBy("file_id").agg(
        F.max("output_bytes").alias("output_bytes"), F.bool_and("decoded").alias("verified")
    )
    catalog = files(spark, sf_dir).select("file_id", "size_bytes")
    removals = catalog.filter(F.col("file_id") % 3 == 0).select("file_id")
    return ops.select_copy(copies, catalog, removals)


CONTAINERS = ("mp4", "webm", "mkv", "mov")
AUDIO_CODECS = ("aac", "opus", "flac", "pcm", "vorbis")


def _triples() -> str:
    rows = [
        f"('{value}', '{stream}', '{codec}')"
        for value, category, video, audio, *_ in dims.OUTPUT_FORMATS
        if category == "video"
        for stream, codecs in (("video", video), ("audio", audio))
        for codec in codecs
    ]
    return ", ".join(rows)


ITEM_SQL = f"""
allowed(container, stream, codec) AS (VALUES {_triples()}),
base AS (SELECT file_id, ordinal, tie_a, tie_b, codec AS video, CASE tie_a % 4 WHEN 0 THEN 'mp4' WHEN 1 THEN 'webm' WHEN 2 THEN 'mkv' ELSE 'mov' END AS container,
  CASE tie_b % 5 WHEN 0 THEN 'aac' WHEN 1 THEN 'opus' WHEN 2 THEN 'flac' WHEN 3 THEN 'pcm' ELSE 'vorbis' END AS audio FROM encode_attempts),
items AS (SELECT file_id, ordinal, tie_a, tie_b, container, 'video' AS stream, video AS codec FROM base
  UNION ALL SELECT file_id, ordinal, tie_a, tie_b, container, 'audio', audio FROM base)"""


def stream_items(spark, sf_dir):
    containers = F.array(*[F.lit(c) for c in CONTAINERS])
    audio = F.array(*[F.lit(c) for c in AUDIO_CODECS])
    return attempts(spark, sf_dir).select(
        "file_id", "ordinal", "tie_a", "tie_b",
        F.element_at(containers, (F.col("tie_a") % 4 + 1).cast("int")).alias("container"),
        F.inline(
            F.array(
                F.struct(F.lit("video").alias("stream"), F.col("codec").alias("codec")),
                F.struct(
                    F.lit("audio").alias("stream"),
                    F.element_at(audio, (F.col("tie_b") % 5 + 1).cast("int")).alias("codec"),
                ),
            )
        ),
    )


@register(
    "j1_codec_violations",
    sql_over(
        ["encode_attempts"],
        f"WITH {ITEM_SQL.strip()} SELECT * FROM items i WHERE NOT EXISTS (SELECT 1 FROM allowed a WHERE a.container = i.container AND a.stream = i.stream AND a.codec = i.codec)",
    ),
)
def codec_violations(spark, sf_dir):
    return ops.codec_violations(stream_items(spark, sf_dir), dims.format_codecs(spark))


@register(
    "j1_codec_allowed",
    sql_over(
        ["encode_attempts"],
        f"""WITH {ITEM_SQL.strip()} SELECT container, stream, codec, count(*) AS items FROM items i
WHERE EXISTS (SELECT 1 FROM allowed a WHERE a.container = i.container AND a.stream = i.stream AND a.codec = i.codec) GROUP BY ALL""",
    ),
)
def codec_allowed(spark, sf_dir):
    allowed = ops.codec_allowed(stream_items(spark, sf_dir), dims.format_codecs(spark))
    return allowed.groupBy("container", "stream", "codec").agg(F.count(F.lit(1)).alias("items"))


@register(
    "a8_pool_scores",
    sql_over(
        ["frame_scores"],
        f"""SELECT candidate_id, {sql_fixed('(CAST(sum(CAST(score AS DECIMAL(28, 6))) AS DOUBLE) / count(*))', 3)} AS mean_score,
  {sql_fixed('min(score)', 3)} AS min_score, count(*) AS frames FROM frame_scores GROUP BY candidate_id""",
    ),
)
def pool_scores(spark, sf_dir):
    return quality_ops.pool_scores(view(spark, sf_dir, "frame_scores"))


@register(
    "w5_low_segments",
    sql_over(
        ["frame_scores"],
        f"""WITH low AS (SELECT *, frame - row_number() OVER (PARTITION BY candidate_id ORDER BY frame) AS island FROM frame_scores WHERE score < 47)
SELECT candidate_id, min(frame) AS first_frame, max(frame) AS last_frame, {sql_fixed('(CAST(min(frame) AS DOUBLE) / 24.0e0)', 3)} AS start_s,
  {sql_fixed('(CAST(max(frame) + 1 AS DOUBLE) / 24.0e0)', 3)} AS end_s, {sql_fixed('min(score)', 3)} AS score FROM low GROUP BY candidate_id, island""",
    ),
)
def low_segments(spark, sf_dir):
    return quality_ops.low_segments(view(spark, sf_dir, "frame_scores"), 47.0, 24.0)


@register(
    "w5_low_segments_by_file",
    sql_over(
        ["frame_scores"],
        f"""WITH t AS (SELECT *, CASE candidate_id % 5 WHEN 0 THEN NULL ELSE 44.0e0 + candidate_id % 5 END AS threshold, CASE WHEN candidate_id % 3 = 0 THEN 0.0e0 ELSE 25.0e0 END AS fps FROM frame_scores),
low AS (SELECT *, CASE WHEN fps > 0 THEN fps ELSE 1.0e0 END AS rate, frame - row_number() OVER (PARTITION BY candidate_id ORDER BY frame) AS island FROM t WHERE score < threshold)
SELECT candidate_id, min(frame) AS first_frame, max(frame) AS last_frame, {sql_fixed('(CAST(min(frame) AS DOUBLE) / max(rate))', 3)} AS start_s,
  {sql_fixed('(CAST(max(frame) + 1 AS DOUBLE) / max(rate))', 3)} AS end_s, {sql_fixed('min(score)', 3)} AS score FROM low GROUP BY candidate_id, island""",
    ),
)
def low_segments_by_file(spark, sf_dir):
    """Threshold and frame rate of each file; one in five has no threshold."""
    kind = F.col("candidate_id") % 5
    return quality_ops.low_segments(
        view(spark, sf_dir, "frame_scores"), F.when(kind != 0, kind.cast("double") + 44.0),
        F.when(F.col("candidate_id") % 3 == 0, 0.0).otherwise(25.0),
    )


@register(
    "a9_pixel_error",
    sql_over(
        [],
        f"""WITH p AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(least(255, greatest(0, floor((CAST(e AS DOUBLE) + 1) * 127.5e0))) AS BIGINT)) AS px FROM embeddings),
j AS (SELECT a.vec_id AS image_id, len(a.px) = len(b.px) AS comparable, len(a.px) AS n,
    CASE WHEN len(a.px) = len(b.px) THEN CAST(list_sum(list_transform(list_zip(a.px, b.px), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) END AS e
  FROM p a JOIN p b ON b.vec_id = a.vec_id + 1)
SELECT image_id, comparable, e AS squared_error, CASE WHEN e > 0 THEN {sql_fixed('(log10(65025.0e0 / (CAST(e AS DOUBLE) / n)) * 10)', 3)} END AS psnr, coalesce(e = 0, false) AS infinite FROM j""",
    ),
)
def pixel_error(spark, sf_dir):
    def pixel(e):
        return F.least(F.lit(255), F.greatest(F.lit(0), F.floor((e.cast("double") + 1) * 127.5))).cast("int")

    images = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("image_id"), F.transform("embedding", pixel).alias("pixels")
    )
    following = images.select((F.col("image_id") - 1).alias("image_id"), "pixels")
    return quality_ops.pixel_error(images, following)
