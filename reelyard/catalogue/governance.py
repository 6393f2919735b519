"""Retention, verification, removal, metadata and error queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..operators import retention
from ..operators import verification as ops
from ..session import shared_dir
from ..sources import sinks
from ..sources.adapters import Derived, sql_over
from . import register

NOW = "1998-08-02 12:00:00"
RESULTS = Derived(
    ["media_files"],
    """SELECT file_id, batch_id, kind, size_bytes, CASE file_id % 4 WHEN 0 THEN 10 WHEN 1 THEN 30 WHEN 2 THEN 45 ELSE 60 END AS minutes, created_at, file_id % 86400 AS second_of_day FROM {media_files}""",
)
RESULTS_SQL = f"""
s AS (SELECT *, created_at + to_seconds(second_of_day) AS made, CASE WHEN minutes IN (10, 30, 60) THEN minutes ELSE 30 END AS ttl FROM ({RESULTS.sql()})),
e AS (SELECT *, made + to_minutes(CAST(ttl AS BIGINT)) AS expires_at FROM s)"""


def results(spark, sf_dir):
    rows = RESULTS.frame(spark, sf_dir)
    made = F.col("created_at") + F.make_dt_interval(secs=F.col("second_of_day"))
    return rows.withColumn("created_at", made).drop("second_of_day")


def now():
    return F.lit(NOW).cast("timestamp_ntz")


@register(
    "p4_active_results",
    sql_over(["media_files"], f"WITH {RESULTS_SQL.strip()} SELECT file_id, kind FROM e WHERE expires_at > TIMESTAMP '{NOW}' AND kind = 'video'"),
)
def active_results(spark, sf_dir):
    rows = retention.with_expiry(results(spark, sf_dir), F.col("minutes"))
    return retention.active_results(rows, now(), "video").select("file_id", "kind")


@register(
    "p5_expired_jobs",
    sql_over(
        ["media_files"],
        f"""WITH {RESULTS_SQL.strip()},
x AS (SELECT file_id AS job_id, made, CASE WHEN file_id % 6 = 0 THEN least(ttl, 10) ELSE ttl END AS ttl_min FROM e)
SELECT job_id, CAST(ttl_min AS INTEGER) AS ttl_min FROM x WHERE TIMESTAMP '{NOW}' - made > to_minutes(CAST(ttl_min AS BIGINT)) AND job_id % 10 <> 0""",
    ),
)
def expired_jobs(spark, sf_dir):
    jobs = results(spark, sf_dir).select(
        F.col("file_id").alias("job_id"), F.col("created_at").alias("last_modified"),
        F.col("minutes").alias("retention_min"), (F.col("file_id") % 6 == 0).alias("failed"),
    )
    active = jobs.filter(F.col("job_id") % 10 == 0).select("job_id")
    return retention.expired_jobs(jobs, now(), active).select("job_id", "ttl_min")


FINISHED = Derived(
    ["events"],
    """SELECT event_id, user_id AS job_id, ts AS created_at, event_id * 17 AS size_bytes, CASE event_id % 4 WHEN 0 THEN 10 WHEN 1 THEN 30 WHEN 2 THEN 45 ELSE 60 END AS minutes,
  CASE event_id % 3 WHEN 0 THEN 'clip ' || CAST(event_id AS STRING) || '_comp.mp4' WHEN 1 THEN 'café ' || CAST(event_id AS STRING) || '*~+.mp4' ELSE 'a<' || CAST(event_id AS STRING) || '>.mp4 .' END AS download_name FROM {events}""",
)


@register(
    "k1_write_results",
    sql_over(
        [],
        f"""WITH r AS ({FINISHED.sql()}),
h AS (SELECT *, CASE event_id % 3 WHEN 0 THEN 'clip ' || event_id || '_comp.mp4' WHEN 1 THEN 'caf_ ' || event_id || '_~+.mp4' ELSE 'a_' || event_id || '_.mp4' END AS plain,
  CASE event_id % 3 WHEN 0 THEN 'clip%20' || event_id || '_comp.mp4' WHEN 1 THEN 'caf%C3%A9%20' || event_id || '_~%2B.mp4' ELSE 'a_' || event_id || '_.mp4' END AS encoded FROM r),
t AS (SELECT *, 'attachment; filename="' || plain || '"; filename*=UTF-8' || chr(39) || chr(39) || encoded AS header FROM h)
SELECT CAST(created_at AS DATE) AS created_date, event_id % 3 AS name_kind, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes,
  CAST(sum(CASE WHEN minutes IN (10, 30, 60) THEN minutes ELSE 30 END) AS BIGINT) AS ttl_minutes,
  count(DISTINCT header) AS headers, min(header) AS first_header, max(header) AS last_header FROM t GROUP BY ALL""",
    ),
)
def write_results(spark, sf_dir):
    path = shared_dir(spark, "results")
    finished = FINISHED.frame(spark, sf_dir)
    sinks.write_results(finished, path, F.col("minutes"))
    written = spark.read.parquet(path)
    ttl = F.timestamp_diff("MINUTE", F.col("created_at"), F.col("expires_at"))
    header = F.col("content_disposition")
    return written.groupBy("created_date", (F.col("event_id") % 3).alias("name_kind")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"),
        F.sum(ttl).alias("ttl_minutes"), F.count_distinct(header).alias("headers"),
        F.min(header).alias("first_header"), F.max(header).alias("last_header"),
    )


HASHES = Derived(
    ["encode_attempts"],
    """SELECT file_id, CAST(tie_a AS STRING) AS before_hash, CASE WHEN tie_b % 10 = 0 THEN CAST(tie_a + 1 AS STRING) ELSE CAST(tie_a AS STRING) END AS after_hash, tie_b % 11 <> 0 AS kept, file_id % 50 <> 0 AS has_input, tie_a % 6 AS dirt FROM {encode_attempts}""",
)
HASH_SQL = f"""
h AS ({HASHES.sql()}),
b AS (SELECT file_id, before_hash AS hash, count(*) AS n FROM h WHERE has_input AND dirt <> 1 GROUP BY ALL),
a AS (SELECT file_id, after_hash AS hash, count(*) AS n FROM h WHERE kept AND dirt <> 2 GROUP BY ALL),
j AS (SELECT coalesce(b.file_id, a.file_id) AS file_id, coalesce(b.hash, a.hash) AS hash, coalesce(b.n, 0) AS nb, coalesce(a.n, 0) AS na FROM b FULL JOIN a ON a.file_id = b.file_id AND a.hash = b.hash)"""


def hash_sides(spark, sf_dir):
    rows = HASHES.frame(spark, sf_dir)
    dirt = F.col("dirt")  # comments and blank lines, and blanks around a hash
    before, after = F.col("before_hash"), F.col("after_hash")
    left = F.when(dirt == 1, F.concat(F.lit(" # "), before)).when(dirt == 3, F.concat(F.lit("  "), before)).otherwise(before)
    right = F.when(dirt == 2, F.lit("   ")).when(dirt == 4, F.concat(after, F.lit(" "))).otherwise(after)
    return (
        rows.filter("has_input").select("file_id", left.alias("hash")),
        rows.filter("kept").select("file_id", right.alias("hash")),
    )


@register(
    "j8_verify_streams",
    sql_over(
        ["encode_attempts"],
        f"""WITH {HASH_SQL.strip()} SELECT file_id, CAST(sum(nb) AS BIGINT) AS input_streams, CAST(sum(na) AS BIGINT) AS output_streams, CAST(sum(greatest(nb - na, 0)) AS BIGINT) AS missing_streams,
  CAST(sum(greatest(na - nb, 0)) AS BIGINT) AS extra_streams, bool_and(na = nb) AND sum(nb) > 0 AS verified FROM j GROUP BY file_id""",
    ),
)
def verify_streams(spark, sf_dir):
    return ops.verify_streams(*hash_sides(spark, sf_dir))


@register(
    "u3_stream_differences",
    sql_over(
        ["encode_attempts"],
        f"""WITH {HASH_SQL.strip()}
SELECT file_id, hash, 'missing' AS side FROM (SELECT file_id, hash, unnest(generate_series(1, nb - na)) FROM j WHERE nb > na)
UNION ALL SELECT file_id, hash, 'extra' FROM (SELECT file_id, hash, unnest(generate_series(1, na - nb)) FROM j WHERE na > nb)""",
    ),
)
def stream_differences(spark, sf_dir):
    return ops.stream_differences(*hash_sides(spark, sf_dir))


OUTPUTS = Derived(
    ["media_files"],
    """SELECT file_id, kind, CASE WHEN kind = 'video' THEN CASE file_id % 4 WHEN 0 THEN 'mp4' WHEN 1 THEN 'mov' WHEN 2 THEN 'webm' ELSE 'mkv' END
    ELSE CASE file_id % 7 WHEN 0 THEN 'mp3' WHEN 1 THEN 'm4a' WHEN 2 THEN 'aac' WHEN 3 THEN 'opus' WHEN 4 THEN 'ogg' WHEN 5 THEN 'wav' ELSE 'flac' END END AS output_format,
  CASE WHEN kind = 'video' AND file_id % 3 <> 0 THEN CASE file_id % 6 WHEN 1 THEN 'h265' WHEN 2 THEN 'h264' WHEN 4 THEN 'av1' ELSE 'h265' END END AS codec,
  CASE WHEN kind = 'video' THEN CASE file_id % 9 WHEN 0 THEN 'MOV,mp4,m4a' WHEN 1 THEN 'matroska,webm' ELSE 'mov,mp4' END ELSE CASE file_id % 7 WHEN 0 THEN 'mp3' WHEN 1 THEN 'mov,mp4' WHEN 2 THEN 'aac' WHEN 5 THEN 'wav' ELSE 'ogg' END END AS format_name,
  CASE WHEN kind = 'video' THEN CASE file_id % 5 WHEN 2 THEN 'hevc' ELSE 'h264' END ELSE CASE file_id % 7 WHEN 0 THEN 'mp3' WHEN 1 THEN 'aac' WHEN 2 THEN 'opus' WHEN 3 THEN 'opus' WHEN 4 THEN 'vorbis' WHEN 5 THEN 'pcm_s16le' ELSE 'flac' END END AS probed_codec,
  CASE WHEN file_id % 61 = 0 THEN 0 ELSE size_bytes END AS output_bytes, file_id % 67 <> 0 AS probed FROM {media_files} WHERE kind <> 'image'""",
)


@register(
    "j9_verify_outputs",
    sql_over(
        ["media_files"],
        f"""WITH o AS (SELECT *, string_split(lower(format_name), ',') AS names FROM ({OUTPUTS.sql()})),
a AS (SELECT *, CASE WHEN kind = 'video' AND output_format IN ('mp4', 'mov') OR output_format = 'm4a' THEN ['mov', 'mp4', 'm4a', '3gp', '3g2', 'mj2'] WHEN kind = 'video' THEN ['matroska', 'webm']
    WHEN output_format = 'opus' THEN ['ogg', 'opus'] ELSE [output_format] END AS allowed,
  CASE WHEN kind = 'video' THEN codec IS NULL OR (codec = 'h265' AND probed_codec IN ('hevc', 'h265')) OR (codec <> 'h265' AND probed_codec = codec)
    WHEN output_format = 'wav' THEN probed_codec LIKE 'pcm%' ELSE probed_codec = CASE WHEN output_format IN ('m4a', 'aac') THEN 'aac' WHEN output_format = 'ogg' THEN 'vorbis' ELSE output_format END END AS codec_ok FROM o)
SELECT file_id, CASE WHEN NOT probed THEN 'NO_OUTPUT' WHEN output_bytes <= 0 THEN 'EMPTY_OUTPUT' WHEN NOT list_has_any(names, allowed) THEN 'OUTPUT_FORMAT_MISMATCH' WHEN NOT codec_ok THEN 'OUTPUT_CODEC_MISMATCH' END AS violation FROM a""",
    ),
)
def verify_outputs(spark, sf_dir):
    rows = OUTPUTS.frame(spark, sf_dir)
    requested = rows.select("file_id", "kind", "output_format", "codec")
    probed = rows.filter("probed").select("file_id", "format_name", "probed_codec", "output_bytes")
    return ops.verify_outputs(requested, probed).select("file_id", "violation")


GROUPS = Derived(
    ["media_files"],
    """SELECT file_id, file_id % 2 = 0 AS strip_privacy, file_id % 3 <> 0 AS same_format, 'd' || CAST(file_id % 9 AS STRING) AS digest FROM {media_files} WHERE kind = 'image'""",
)
# group, present before when (id % a = 0), present after when (id % b <> 0), changed when (id % c = 0)
GROUP_RULES = (("icc", 2, 29, 31), ("density", 3, 37, 41), ("exif", 5, 4, 43), ("xmp", 7, 6, 47), ("iptc", 11, 8, 53))


@register(
    "j10_verify_metadata",
    sql_over(
        ["media_files"],
        f"""WITH g AS ({GROUPS.sql()}),
s AS ({' UNION ALL '.join(f"SELECT file_id, strip_privacy, same_format, '{n}' AS grp, CASE WHEN file_id % {a} = 0 THEN digest END AS a, CASE WHEN file_id % {a} = 0 AND file_id % {b} <> 0 THEN CASE WHEN file_id % {c} = 0 THEN 'changed' ELSE digest END END AS b FROM g" for n, a, b, c in GROUP_RULES)}),
i AS (SELECT file_id, min(CASE WHEN grp = 'icc' AND a IS NOT NULL AND a IS DISTINCT FROM b THEN 1 WHEN grp = 'density' AND same_format AND a IS NOT NULL AND a IS DISTINCT FROM b THEN 2
  WHEN grp IN ('exif', 'xmp', 'iptc') AND strip_privacy AND b IS NOT NULL THEN 3 WHEN grp IN ('exif', 'xmp', 'iptc') AND NOT strip_privacy AND a IS DISTINCT FROM b THEN 4 END) AS issue FROM s GROUP BY file_id)
SELECT file_id, issue IS NULL AS passed, CASE issue WHEN 1 THEN 'icc-lost' WHEN 2 THEN 'density-lost' WHEN 3 THEN 'privacy-left' WHEN 4 THEN 'metadata-changed' ELSE 'kept' END AS reason FROM i""",
    ),
)
def verify_metadata(spark, sf_dir):
    rows = GROUPS.frame(spark, sf_dir)
    file_id = F.col("file_id")

    def side(after: bool):
        entries = []
        for name, a, b, c in GROUP_RULES:
            present = file_id % a == 0
            digest = F.col("digest")
            if after:
                present = present & (file_id % b != 0)
                digest = F.when(file_id % c == 0, "changed").otherwise(digest)
            entries.append(F.when(present, F.struct(F.lit(name).alias("grp"), digest.alias("digest"))))
        return rows.select("file_id", F.inline(F.array_compact(F.array(*entries))))

    policy = rows.select("file_id", "strip_privacy", "same_format")
    return ops.verify_metadata(side(False), side(True), policy)


@register(
    "u2_removed_types",
    sql_over(
        ["media_files"],
        """WITH t AS (SELECT file_id, unnest(['EXIF', 'XMP', 'IPTC', 'GPS']) AS type, unnest([2, 3, 5, 7]) AS k FROM media_files WHERE kind = 'image')
SELECT file_id, coalesce(string_agg(CASE WHEN file_id % k = 0 AND NOT (file_id % (k + 1) = 0 AND file_id % 4 <> 1) THEN type END, ',' ORDER BY k), '') AS removed FROM t GROUP BY file_id""",
    ),
)
def removed_types(spark, sf_dir):
    from ..sources.adapters import view

    images = view(spark, sf_dir, "media_files").filter("kind = 'image'")
    file_id = F.col("file_id")
    kinds = (("EXIF", 2), ("XMP", 3), ("IPTC", 5), ("GPS", 7))
    before = images.select(
        "file_id", F.array_compact(F.array(*[F.when(file_id % k == 0, F.lit(n)) for n, k in kinds])).alias("types")
    )
    after = images.filter(file_id % 4 != 1).select(
        "file_id",
        F.array_compact(F.array(*[F.when(file_id % (k + 1) == 0, F.lit(n)) for n, k in kinds])).alias("types"),
    )
    return ops.removed_types(before, after).select("file_id", F.array_join("removed", ",").alias("removed"))


STREAMS = Derived(
    ["media_files"],
    """SELECT file_id, batch_id, audio_track_count, file_id % 3 AS subtitles, file_id % 4 = 0 AS attachment, file_id % 7 = 0 AS picture, CAST(file_id % 5 AS INT) AS chapter_count, file_id % 6 AS tag_count, file_id % 2 = 0 AS keep_primary_audio,
  file_id % 8 <> 0 AS remove_subtitles, file_id % 9 <> 0 AS remove_attachments, file_id % 3 <> 1 AS remove_chapters, file_id % 5 <> 2 AS strip_privacy FROM {media_files} WHERE kind = 'video'""",
)
REMOVAL_SQL = f"""
f AS ({STREAMS.sql()}),
i AS (SELECT file_id, 'audio' AS category, CASE WHEN (n + 1) % 2 = 0 THEN 'track ' || CAST(n + 1 AS VARCHAR) ELSE '#' || CAST(n + 1 AS VARCHAR) END AS detail
    FROM (SELECT file_id, unnest(generate_series(1, CAST(audio_track_count AS BIGINT))) AS n FROM f WHERE keep_primary_audio) WHERE n > 1
  UNION ALL SELECT file_id, 'subtitle', CASE WHEN n % 2 = 0 THEN 'eng' ELSE '#' || CAST(10 + n AS VARCHAR) END FROM (SELECT file_id, unnest(generate_series(1, subtitles)) AS n FROM f WHERE remove_subtitles)
  UNION ALL SELECT file_id, 'attachment', 'font.ttf' FROM f WHERE attachment AND remove_attachments UNION ALL SELECT file_id, 'attachment', 'cover' FROM f WHERE picture AND remove_attachments
  UNION ALL SELECT file_id, 'metadata', 'tag' || CAST(n AS VARCHAR) FROM (SELECT file_id, unnest(generate_series(1, tag_count)) AS n FROM f WHERE strip_privacy))"""
COUNT_SQL = f"""{REMOVAL_SQL.strip()},
c AS (SELECT file_id, category, count(*) AS items FROM i GROUP BY ALL UNION ALL SELECT file_id, 'chapter', chapter_count FROM f WHERE remove_chapters AND chapter_count > 0)"""


def stream_tables(spark, sf_dir):
    rows = STREAMS.frame(spark, sf_dir)
    none = F.lit(None).cast("string")

    def stream(idx, kind, picture, title, language, filename):
        return F.struct(
            idx.cast("int").alias("idx"), F.lit(kind).alias("type"), F.lit(picture).alias("is_attached_picture"),
            title.alias("title"), language.alias("language"), filename.alias("filename"),
        )

    empty = F.array().cast(
        "array<struct<idx:int,type:string,is_attached_picture:boolean,title:string,language:string,filename:string>>"
    )
    audio = F.transform(
        F.sequence(F.lit(1), F.col("audio_track_count")),
        lambda n: stream(n + 1, "audio", False, F.when((n + 1) % 2 == 0, F.concat(F.lit("track "), (n + 1).cast("string"))), F.lit("eng"), none),
    )
    subtitles = F.transform(
        F.sequence(F.lit(1).cast("bigint"), F.col("subtitles")),
        lambda n: stream(n + 10, "subtitle", False, none, F.when(n % 2 == 0, "eng"), none),
    )
    streams = F.concat(
        F.array(stream(F.lit(1), "video", False, none, none, none)),
        F.when(F.col("audio_track_count") > 0, audio).otherwise(empty),
        F.when(F.col("subtitles") > 0, subtitles).otherwise(empty),
        F.when(F.col("attachment"), F.array(stream(F.lit(20), "attachment", False, F.lit("a font"), none, F.lit("font.ttf")))).otherwise(empty),
        F.when(F.col("picture"), F.array(stream(F.lit(21), "video", True, F.lit("cover"), none, none))).otherwise(empty),
    )
    tags = F.when(
        F.col("tag_count") > 0,
        F.map_from_entries(
            F.transform(
                F.sequence(F.lit(1).cast("bigint"), F.col("tag_count")),
                lambda n: F.struct(F.concat(F.lit("tag"), n.cast("string")), F.lit("value")),
            )
        ),
    ).otherwise(F.create_map().cast("map<string,string>"))
    return rows.select("file_id", F.inline(streams)), rows.withColumn("format_tags", tags)


@register("a10_removal_items", sql_over(["media_files"], f"WITH {REMOVAL_SQL.strip()} SELECT * FROM i"))
def removal_items(spark, sf_dir):
    return ops.removal_items(*stream_tables(spark, sf_dir))


@register("a10_removal_counts", sql_over(["media_files"], f"WITH {COUNT_SQL} SELECT * FROM c"))
def removal_counts(spark, sf_dir):
    return ops.removal_counts(*stream_tables(spark, sf_dir))


@register(
    "a10_removal_totals",
    sql_over(["media_files"], f"WITH {COUNT_SQL} SELECT batch_id, category, count(*) AS files, CAST(sum(items) AS BIGINT) AS items FROM c JOIN f USING (file_id) GROUP BY ALL"),
)
def removal_totals(spark, sf_dir):
    streams, files = stream_tables(spark, sf_dir)
    return ops.removal_totals(ops.removal_counts(streams, files), files)


#: All known codes, one unknown and none at all, dealt over the events.
CODE_LIST = (*sorted(dims.ERROR_STATUS), "BAD_REQUEST", None)
CODE_CASES = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CODE_LIST) if c)
ERRORS = Derived(
    ["events"],
    f"""SELECT event_id, CASE event_id % {len(CODE_LIST)} {CODE_CASES} END AS code FROM {{events}} WHERE event_type IN ('error', 'view')""",
)
STATUS_ROWS = ", ".join(f"('{c}', {n})" for c, n in sorted(dims.ERROR_STATUS.items()))


@register(
    "j16_classify_errors",
    sql_over(
        [],
        f"""WITH e AS ({ERRORS.sql()}), c(code, http_status) AS (VALUES {STATUS_ROWS})
SELECT e.code, coalesce(c.http_status, 400) AS http_status, coalesce(e.code IN ('PROCESSING_TIMEOUT', 'INSUFFICIENT_STORAGE'), false) AS retryable, c.code IS NOT NULL AS classified, count(*) AS errors FROM e LEFT JOIN c ON c.code = e.code GROUP BY ALL""",
    ),
)
def classify_errors(spark, sf_dir):
    return ops.error_counts(ops.classify_errors(ERRORS.frame(spark, sf_dir)))


TAG_NAMES = (
    "ImageWidth", "GPSLatitude", "Creator", "Headline", "Make", "Model", "ISO", "BitDepth", "Rating", "Keywords", "GPSAltitude", "Lens",
)
TAG_BASE = Derived(["media_files"], "SELECT file_id FROM {media_files} WHERE kind = 'image'")


@register(
    "p12_metadata_report",
    sql_over(
        ["media_files"],
        f"""WITH b AS ({TAG_BASE.sql()}),
t AS (SELECT file_id, pos, ([{', '.join(f"'{n}'" for n in TAG_NAMES)}])[CAST((pos * 7 + file_id) % 12 + 1 AS INTEGER)] AS key, CASE WHEN (pos + file_id) % 10 <> 0 THEN 'v' || CAST(pos AS VARCHAR) END AS value
  FROM (SELECT file_id, unnest(generate_series(0, 35)) AS pos FROM b)),
r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY pos) AS rn FROM t WHERE value IS NOT NULL AND key NOT IN ('ImageWidth', 'BitDepth')),
g AS (SELECT *, CASE WHEN key LIKE 'GPS%' THEN 'GPS' WHEN key IN ('Creator', 'Rating') THEN 'XMP' WHEN key IN ('Headline', 'Keywords') THEN 'IPTC' ELSE 'EXIF' END AS grp FROM r WHERE rn <= 24)
SELECT file_id, CAST(pos AS INTEGER) AS pos, key, value, grp FROM g WHERE grp = 'GPS' OR (grp = 'EXIF' AND file_id % 2 = 0) OR (grp = 'XMP' AND file_id % 3 = 0) OR (grp = 'IPTC' AND file_id % 5 = 0)""",
    ),
)
def metadata_report(spark, sf_dir):
    base = TAG_BASE.frame(spark, sf_dir)
    names = F.array(*[F.lit(n) for n in TAG_NAMES])
    file_id, pos = F.col("file_id"), F.col("pos")
    tags = base.select("file_id", F.explode(F.sequence(F.lit(0), F.lit(35))).alias("pos")).select(
        "file_id", "pos",
        F.element_at(names, ((pos * 7 + file_id) % 12 + 1).cast("int")).alias("key"),
        F.when((pos + file_id) % 10 != 0, F.concat(F.lit("v"), pos.cast("string"))).alias("value"),
    )
    found = F.array_compact(
        F.array(
            F.when(file_id % 2 == 0, "EXIF"), F.when(file_id % 3 == 0, "XMP"), F.when(file_id % 5 == 0, "IPTC")
        )
    )
    detected = base.select("file_id", F.explode(found).alias("grp"))
    return ops.metadata_report(tags, detected)
