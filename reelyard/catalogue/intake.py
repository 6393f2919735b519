"""Intake, probe and settings queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions import labels
from ..functions.numbers import bytes_in_unit, size_in_bytes
from ..operators import intake as ops
from ..operators import naming
from ..operators import settings as settings_ops
from ..session import shared_dir
from ..sources import files as file_sources
from ..sources import probes
from ..sources.adapters import Derived, sql_fixed, sql_over, table, view
from ..sources.heads import open_root
from . import register

TRIAGE = Derived(
    ["media_files"],
    """SELECT file_id, CASE WHEN file_id % 29 = 0 THEN 'unknown' ELSE kind END AS kind, CASE WHEN file_id % 101 = 0 THEN 0 ELSE size_bytes END AS size_bytes, file_id % 97 = 0 AS executable,
  width * CASE WHEN file_id % 23 = 0 THEN 8 ELSE 1 END AS width, height * CASE WHEN file_id % 46 = 0 THEN 8 ELSE 1 END AS height,
  CASE WHEN file_id % 13 = 0 THEN 1 + file_id % 200 ELSE 1 END AS pages, kind = 'image' AND file_id % 17 = 0 AS svg, file_id % 34 = 0 AS unsafe_svg,
  CASE WHEN file_id % 19 = 0 THEN 'video' ELSE kind END AS signature_kind, duration_s * CASE WHEN file_id % 3 = 0 THEN 2 ELSE 1 END AS duration_s
FROM {media_files}""",
)

TRIAGE_SQL = f"""
t AS ({TRIAGE.sql()}),
c AS (SELECT *, CASE WHEN size_bytes = 0 THEN 'EMPTY_FILE' WHEN size_bytes > 262144000 THEN 'FILE_TOO_LARGE' WHEN executable THEN 'EXECUTABLE_REJECTED' WHEN kind = 'unknown' THEN 'UNSUPPORTED_TYPE'
  WHEN kind = 'image' AND (width > 16384 OR height > 16384 OR CAST(width AS BIGINT) * height > 40000000) THEN 'IMAGE_DIMENSIONS_TOO_LARGE'
  WHEN kind = 'image' AND (pages > 120 OR CAST(width AS BIGINT) * height * pages > 80000000) THEN 'ANIMATION_TOO_LARGE'
  WHEN kind = 'image' AND svg AND size_bytes > 2097152 THEN 'SVG_TOO_LARGE' WHEN kind = 'image' AND svg AND unsafe_svg THEN 'UNSAFE_SVG'
  WHEN kind = 'image' AND size_bytes > 26214400 THEN 'FILE_TOO_LARGE' WHEN kind = 'image' AND signature_kind <> 'image' THEN 'TYPE_MISMATCH'
  WHEN kind <> 'image' AND duration_s > 1800 THEN 'MEDIA_DURATION_TOO_LONG' WHEN kind = 'audio' AND size_bytes > 104857600 THEN 'FILE_TOO_LARGE'
  WHEN kind = 'video' AND (width > 7680 OR height > 4320) THEN 'VIDEO_DIMENSIONS_TOO_LARGE' ELSE 'ACCEPTED' END AS code FROM t)"""


@register("p1_triage_intake", sql_over(["media_files"], f"WITH {TRIAGE_SQL.strip()} SELECT file_id, code FROM c"))
def triage_intake(spark, sf_dir):
    return ops.triage_intake(TRIAGE.frame(spark, sf_dir)).select("file_id", "code")


@register(
    "p1_triage_counts",
    sql_over(
        ["media_files"],
        f"""WITH {TRIAGE_SQL.strip()} SELECT kind, code, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes,
  CASE code WHEN 'EMPTY_FILE' THEN 400 WHEN 'ACCEPTED' THEN 200 WHEN 'EXECUTABLE_REJECTED' THEN 415 WHEN 'UNSAFE_SVG' THEN 415 WHEN 'TYPE_MISMATCH' THEN 415 WHEN 'UNSUPPORTED_TYPE' THEN 415 ELSE 413 END AS http_status
FROM c GROUP BY kind, code""",
    ),
)
def triage_counts(spark, sf_dir):
    return ops.triage_counts(ops.triage_intake(TRIAGE.frame(spark, sf_dir)))


HEADERS = Derived(
    ["documents"],
    """SELECT doc_id, text, doc_id % 9 AS lead FROM {documents}""",
)


def _headed(spark, sf_dir):
    """``doc_id, path, content``: documents, some behind the first bytes of an executable."""
    lead = F.col("lead")
    magic = (
        F.when(lead == 0, F.unhex(F.lit("4D5A")))
        .when(lead == 1, F.unhex(F.lit("2321")))
        .when(lead == 2, F.unhex(F.lit("7F454C46")))
        .when(lead == 3, F.unhex(F.lit("CFFAEDFE")))
        .otherwise(F.unhex(F.lit("")))
    )
    content = F.concat(magic, F.encode("text", "UTF-8"))
    return HEADERS.frame(spark, sf_dir).select(
        "doc_id", F.concat(F.lit("doc-"), "doc_id").alias("path"), content.alias("content")
    )


@register(
    "s9_classify_headers",
    sql_over(
        [],
        """SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS path, CAST(strlen(text) + CASE doc_id % 9 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 4 ELSE 0 END AS BIGINT) AS size_bytes,
  doc_id % 9 < 4 OR text LIKE 'MZ%' OR text LIKE '#!%' AS executable FROM documents""",
    ),
)
def classify_headers(spark, sf_dir):
    return ops.classify_headers(_headed(spark, sf_dir).withColumn("length", F.octet_length("content").cast("bigint")))


def _write_files(rows, root):
    """One file ``<folder>/<name>`` per row below ``root``; a task that runs again writes the same."""

    def write(batches):
        for batch in batches:
            system, base, _ = open_root(root)
            for folder, name, content in zip(*(batch[c].to_pylist() for c in ("folder", "name", "content")), strict=True):
                system.create_dir(f"{base}/{folder}")
                with system.open_output_stream(f"{base}/{folder}/{name}") as file:
                    file.write(content)
            yield batch.select(["name"])

    rows.select("folder", "name", "content").mapInArrow(write, "name string").write.format("noop").mode("overwrite").save()


@register(
    "s9_scan_folder",
    sql_over(
        [],
        """SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS name, CASE WHEN doc_id % 11 = 0 THEN 0 ELSE CAST(strlen(text) + CASE doc_id % 9 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 4 ELSE 0 END AS BIGINT) END AS size_bytes,
  doc_id % 11 <> 0 AND (doc_id % 9 < 4 OR text LIKE 'MZ%' OR text LIKE '#!%') AS executable FROM documents""",
    ),
)
def scan_folder(spark, sf_dir):
    """Every document as a file in one of twenty folders, one in eleven empty; then the scan of them all."""
    root = shared_dir(spark, "intake-files")
    content = F.when(F.col("doc_id") % 11 == 0, F.unhex(F.lit(""))).otherwise(F.col("content"))
    rows = _headed(spark, sf_dir).select(
        F.concat(F.lit("n"), F.col("doc_id") % 20).alias("folder"), F.col("path").alias("name"), content.alias("content")
    )
    _write_files(rows, root)
    return file_sources.scan_intake(spark, root).select(F.substring_index("path", "/", -1).alias("name"), "size_bytes", "executable")


SVG_REASONS_SQL = """
SELECT page_id, regexp_matches(html, '(?i)<!DOCTYPE') AS doctype, regexp_matches(html, '(?i)<!ENTITY') AS entity, regexp_matches(html, '(?i)<script\\b') AS script,
  regexp_matches(html, '(?i)\\son[a-z]+\\s*=') AS event_handler, regexp_matches(html, '(?i)(?:href|xlink:href)\\s*=\\s*["'']\\s*(?:https?:|ftp:|file:)') AS external_reference FROM pages"""


def scanned_pages(spark, sf_dir):
    return ops.scan_svg(
        table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.encode("html", "UTF-8").alias("content"))
    )


@register(
    "s10_scan_svg",
    sql_over(
        [],
        f"""WITH s AS ({SVG_REASONS_SQL.strip()})
SELECT page_id AS id, doctype, entity, script, event_handler, external_reference, doctype OR entity OR script OR event_handler OR external_reference AS unsafe FROM s""",
    ),
)
def scan_svg(spark, sf_dir):
    return scanned_pages(spark, sf_dir)


@register(
    "s10_svg_reasons",
    sql_over(
        [],
        f"""WITH s AS ({SVG_REASONS_SQL.strip()}),
r AS (SELECT 'doctype' AS reason, doctype AS hit FROM s UNION ALL SELECT 'entity', entity FROM s UNION ALL SELECT 'script', script FROM s
  UNION ALL SELECT 'event-handler', event_handler FROM s UNION ALL SELECT 'external-reference', external_reference FROM s)
SELECT reason, count(*) AS documents FROM r WHERE hit GROUP BY reason""",
    ),
)
def svg_reasons(spark, sf_dir):
    return ops.svg_reasons(scanned_pages(spark, sf_dir))


@register(
    "s12_duplicate_content",
    sql_over(
        [],
        """WITH h AS (SELECT doc_id, sha256(text) AS digest, strlen(text) AS bytes FROM documents)
SELECT digest, count(*) AS copies, CAST(sum(bytes) AS BIGINT) AS total_bytes, min(doc_id) AS first_id, CAST(sum(bytes) - min(bytes) AS BIGINT) AS duplicate_bytes
FROM h GROUP BY digest HAVING count(*) > 1""",
    ),
)
def duplicate_content(spark, sf_dir):
    content = F.encode("text", "UTF-8")
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), content.alias("content"),
        F.octet_length("text").cast("bigint").alias("size_bytes"),
    )
    return ops.duplicate_content(rows)


CENSUS = Derived(
    ["part"],
    """SELECT p_brand AS batch_id, p_partkey AS size_bytes,
  p_name || CASE p_partkey % 9 WHEN 0 THEN '.jpg' WHEN 1 THEN '.PNG' WHEN 2 THEN '.mp4' WHEN 3 THEN '.FLAC' WHEN 4 THEN '.xyz' WHEN 5 THEN '' WHEN 6 THEN '.tar.mkv' WHEN 7 THEN '.opus' ELSE '.tiff' END AS name,
  CASE p_partkey % 7 WHEN 0 THEN 'video/mp4' WHEN 1 THEN 'image/png' WHEN 2 THEN 'application/pdf' WHEN 3 THEN 'audio/mpeg' END AS mime FROM {part}""",
)
KIND_SQL = """CASE WHEN mime LIKE 'image/%' THEN 'image' WHEN mime LIKE 'video/%' THEN 'video' WHEN mime LIKE 'audio/%' THEN 'audio'
  WHEN regexp_matches(lower(name), '\\.(jpg|jpeg|png|webp|avif|gif|tif|tiff)$') THEN 'image' WHEN regexp_matches(lower(name), '\\.(mp4|mov|mkv|webm|avi|m4v)$') THEN 'video'
  WHEN regexp_matches(lower(name), '\\.(mp3|m4a|aac|wav|flac|ogg|opus)$') THEN 'audio' ELSE 'unknown' END"""


@register(
    "p10_kind_census",
    sql_over([], f"WITH c AS ({CENSUS.sql()}) SELECT batch_id, {KIND_SQL} AS kind, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM c GROUP BY ALL"),
)
def kind_census(spark, sf_dir):
    return ops.kind_census(CENSUS.frame(spark, sf_dir))


@register(
    "p10_unknown_share",
    sql_over([], f"WITH c AS ({CENSUS.sql()}) SELECT batch_id, count(*) AS files, count(*) FILTER ({KIND_SQL} = 'unknown') AS unknown_files FROM c GROUP BY batch_id"),
)
def unknown_share(spark, sf_dir):
    return ops.unknown_share(CENSUS.frame(spark, sf_dir))


IDENTITY = Derived(
    ["media_files"],
    """SELECT batch_id, file_id AS ord, kind || '-' || CAST(file_id % 3 AS STRING) AS name, priority AS modified,
  CASE WHEN file_id % 17 = 0 THEN 0 WHEN file_id % 19 = 0 THEN 262144001 WHEN file_id % 23 = 0 THEN NULL ELSE coalesce(height, 100) END AS size_bytes,
  CASE WHEN file_id % 13 = 0 THEN 'application/X-MSDownload' WHEN file_id % 3 = 0 THEN 'image/png' END AS mime FROM {media_files}""",
)


@register(
    "w10_admit",
    sql_over(
        ["media_files"],
        f"""WITH i AS ({IDENTITY.sql()}),
r AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY ord) AS rank, CASE WHEN coalesce(size_bytes, 0) <= 0 THEN 'empty' WHEN size_bytes > 262144000 THEN 'oversized'
  WHEN regexp_matches(mime, '(?i)x-msdownload|x-executable|x-dosexec') THEN 'executable' END AS fault FROM i),
d AS (SELECT *, row_number() OVER (PARTITION BY batch_id, name, size_bytes, modified ORDER BY ord) AS dup FROM r WHERE rank <= 10 AND fault IS NULL)
SELECT batch_id, ord, CASE WHEN dup > 1 THEN 'duplicate' ELSE 'admitted' END AS outcome FROM d
UNION ALL SELECT batch_id, ord, CASE WHEN rank > 10 THEN 'over-limit' ELSE fault END FROM r WHERE rank > 10 OR fault IS NOT NULL""",
    ),
)
def admit(spark, sf_dir):
    return ops.admit(IDENTITY.frame(spark, sf_dir)).select("batch_id", "ord", "outcome")


KNOWN = Derived(
    ["media_files"],
    """SELECT kind || '-' || CAST(file_id % 50 AS STRING) AS name, coalesce(height, 0) + batch_id % 20 AS size_bytes, priority AS modified, status, file_id FROM {media_files}""",
)


@register(
    "j15_new_files",
    sql_over(
        ["media_files"],
        f"""WITH i AS ({KNOWN.sql()})
SELECT file_id, name, size_bytes, modified FROM i a WHERE status <> 'completed'
  AND NOT EXISTS (SELECT 1 FROM i b WHERE b.status = 'completed' AND b.name = a.name AND b.size_bytes = a.size_bytes AND b.modified = a.modified)""",
    ),
)
def new_files(spark, sf_dir):
    rows = KNOWN.frame(spark, sf_dir)
    incoming = rows.filter("status <> 'completed'")
    known = rows.filter("status = 'completed'").select("name", "size_bytes", "modified")
    return ops.new_files(incoming, known).select("file_id", "name", "size_bytes", "modified")


@register(
    "w7_unique_names",
    sql_over(
        ["file_names"],
        """WITH n AS (SELECT *, regexp_replace(original_name, '\\.[^.]*$', '') || '_comp' AS base FROM file_names),
r AS (SELECT *, row_number() OVER (PARTITION BY batch_id, lower(base) ORDER BY ord) AS rn FROM n)
SELECT batch_id, ord, base || CASE WHEN rn > 1 THEN '_' || CAST(rn AS VARCHAR) ELSE '' END || '.' || output_ext AS download_name FROM r""",
    ),
)
def unique_names(spark, sf_dir):
    return naming.unique_names(view(spark, sf_dir, "file_names")).select("batch_id", "ord", "download_name")


URL_NAMES = Derived(
    ["pages"],
    """SELECT page_id % 5 AS batch_id, page_id AS ord, CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 3 = 1 THEN 'Été ' || CAST(page_id % 4 AS STRING) || '. .JPG' ELSE 'con.png' END AS original_name,
  CASE WHEN page_id % 2 = 0 THEN '.WebP' ELSE 'png' END AS output_ext FROM {pages}""",
)


@register(
    "w7_unique_names_urls",
    sql_over(
        [],
        f"""WITH u AS ({URL_NAMES.sql()}),
s AS (SELECT *, regexp_replace(regexp_replace(nfc_normalize(original_name), '[\\x00-\\x1f\\x7f<>:"/\\\\|?*]', '_', 'g'), '[. ]+$', '') AS clean, CASE WHEN ord % 2 = 0 THEN 'webp' ELSE 'png' END AS ext FROM u),
c AS (SELECT *, CASE WHEN regexp_matches(clean, '(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\\..*)?$') THEN '_' || clean ELSE clean END AS safe FROM s),
b AS (SELECT *, regexp_replace(CASE WHEN contains(safe, '.') THEN regexp_replace(safe, '\\.[^.]*$', '') ELSE safe END, '[. ]+$', '') || '_comp' AS base FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY batch_id, lower(base), ext ORDER BY ord) AS rn FROM b)
SELECT batch_id, ord, base || CASE WHEN rn > 1 THEN '_' || CAST(rn AS VARCHAR) ELSE '' END || '.' || ext AS download_name FROM r""",
    ),
)
def unique_names_urls(spark, sf_dir):
    return naming.unique_names(URL_NAMES.frame(spark, sf_dir)).select("batch_id", "ord", "download_name")


ADVICE = Derived(
    ["media_files"], "SELECT file_id, kind, width, height, has_alpha, file_id % 13 = 0 AS animated FROM {media_files}"
)
ADVICE_SQL = f"""
a AS ({ADVICE.sql()}),
r AS (
  SELECT file_id, 'image-alpha-lossless' AS recommendation FROM a WHERE kind = 'image' AND has_alpha
  UNION ALL SELECT file_id, 'image-animation' FROM a WHERE kind = 'image' AND animated
  UNION ALL SELECT file_id, 'image-ai-2x' FROM a WHERE kind = 'image' AND greatest(width, height) < 1280
  UNION ALL SELECT file_id, 'video-1080p' FROM a WHERE kind = 'video' AND height >= 2160
  UNION ALL SELECT file_id, unnest(['video-compatible', 'video-small']) FROM a WHERE kind = 'video'
  UNION ALL SELECT file_id, unnest(['audio-compatible', 'audio-small']) FROM a WHERE kind = 'audio')"""


@register("p9_recommendations", sql_over(["media_files"], f"WITH {ADVICE_SQL.strip()} SELECT * FROM r"))
def recommendations(spark, sf_dir):
    return ops.recommendations(ADVICE.frame(spark, sf_dir))


@register(
    "p9_recommendation_counts",
    sql_over(["media_files"], f"WITH {ADVICE_SQL.strip()} SELECT recommendation, count(*) AS files FROM r GROUP BY recommendation"),
)
def recommendation_counts(spark, sf_dir):
    return ops.recommendation_counts(ops.recommendations(ADVICE.frame(spark, sf_dir)))


SETTINGS = Derived(
    ["media_files"],
    """SELECT batch_id, file_id, CASE WHEN file_id % 41 = 0 THEN 'unknown' ELSE kind END AS kind,
  CASE WHEN batch_id % 9 = 0 THEN 'complete' WHEN status = 'completed' THEN 'complete' WHEN status = 'processing' THEN 'queued' ELSE 'error' END AS status,
  CASE WHEN file_id % 37 = 0 THEN 'uploading' ELSE 'ready' END AS inspection_status, CASE WHEN file_id % 29 <> 0 THEN CAST(file_id AS STRING) END AS upload_id,
  CASE file_id % 6 WHEN 0 THEN 'webp' WHEN 1 THEN 'mp4' WHEN 2 THEN 'jpeg' WHEN 3 THEN 'webm' WHEN 4 THEN 'mp3' END AS item_format,
  CASE batch_id % 5 WHEN 0 THEN 'strict-lossless' WHEN 1 THEN 'target-size' WHEN 2 THEN 'lossless' ELSE 'reduce-size' END AS processing_mode,
  CASE batch_id % 4 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' WHEN 2 THEN 'webp' ELSE 'bmp' END AS image_format, CASE WHEN batch_id % 3 = 0 THEN 'lossless' ELSE 'lossy' END AS image_encoding,
  CAST(batch_id % 110 AS INT) AS image_quality, CASE batch_id % 3 WHEN 0 THEN '#FFFFFF' WHEN 1 THEN 'white' END AS jpeg_background,
  CASE WHEN batch_id % 2 = 0 THEN 'copy' ELSE 'compress' END AS video_mode, CASE batch_id % 3 WHEN 0 THEN 'original' WHEN 1 THEN 'custom' ELSE '720' END AS video_resolution,
  CASE batch_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 721 WHEN 2 THEN 720 ELSE 100 END AS custom_height,
  CASE batch_id % 5 WHEN 0 THEN 'h264' WHEN 1 THEN 'h265' WHEN 2 THEN 'vp9' WHEN 3 THEN 'av1' ELSE 'mpeg2' END AS video_codec,
  'balanced' AS video_quality, CASE WHEN batch_id % 7 = 0 THEN 'mp2' ELSE 'copy' END AS video_audio,
  CASE batch_id % 6 WHEN 0 THEN 'source' WHEN 1 THEN 'mp4' WHEN 2 THEN 'webm' WHEN 3 THEN 'mkv' WHEN 4 THEN 'mov' END AS video_container,
  CASE batch_id % 3 WHEN 0 THEN 'reduce-size' WHEN 1 THEN 'lossless' ELSE 'nonsense' END AS audio_mode, CASE batch_id % 4 WHEN 0 THEN 'mp3' WHEN 1 THEN 'flac' WHEN 2 THEN 'wav' ELSE 'wma' END AS audio_format,
  'high' AS audio_quality, batch_id % 2 = 0 AS target_enabled, CASE WHEN batch_id % 3 = 0 THEN batch_id - 300 END AS target_bytes, CASE WHEN batch_id % 4 = 0 THEN 0.5e0 END AS target_ratio
FROM {media_files}""",
)
_VIDEO_TAKES = """((container = 'mp4' AND video_codec IN ('h264', 'h265', 'av1')) OR (container = 'webm' AND video_codec IN ('vp9', 'av1'))
  OR (container = 'mkv' AND video_codec IN ('h264', 'h265', 'vp9', 'av1')) OR (container = 'mov' AND video_codec IN ('h264', 'h265')))"""
_IMAGES = "('jpeg', 'png', 'webp', 'avif', 'tiff', 'gif')"
_AUDIOS = "('mp3', 'm4a', 'aac', 'opus', 'ogg', 'wav', 'flac')"
_HEIGHT_OK = "(custom_height IS NOT NULL AND custom_height BETWEEN 144 AND 4320 AND custom_height % 2 = 0)"
_AUDIO_OK = f"(audio_mode <> 'nonsense' AND audio_format IN {_AUDIOS})"
RULES_SQL = {
    "not-inspected": "inspection_status <> 'ready'",
    "unknown-kind": "kind = 'unknown'",
    "missing-upload": "kind IN ('video', 'audio') AND upload_id IS NULL",
    "image-format": f"kind = 'image' AND image_format NOT IN {_IMAGES}",
    "image-item-format": f"kind = 'image' AND item_format IS NOT NULL AND item_format NOT IN {_IMAGES}",
    "jpeg-background": "kind = 'image' AND coalesce(item_format, image_format) = 'jpeg' AND NOT regexp_matches(coalesce(jpeg_background, '#ffffff'), '(?i)^#[0-9a-f]{{6}}$')",
    "image-quality": "kind = 'image' AND NOT (image_format = 'png' OR (image_encoding = 'lossless' AND image_format IN ('webp', 'avif', 'tiff'))) AND NOT image_quality BETWEEN 1 AND 100",
    "lossless-image": "kind = 'image' AND processing_mode IN ('lossless', 'strict-lossless') AND (image_format = 'jpeg' OR image_encoding = 'lossy')",
    "video-item-format": "kind = 'video' AND item_format IS NOT NULL AND item_format NOT IN ('mp4', 'webm', 'mkv', 'mov')",
    "custom-height": f"kind = 'video' AND video_resolution = 'custom' AND NOT {_HEIGHT_OK}",
    "video-options": f"kind = 'video' AND (video_codec = 'mpeg2' OR video_audio = 'mp2' OR (custom_height IS NOT NULL AND NOT {_HEIGHT_OK}))",
    "webm-codec": "kind = 'video' AND video_container = 'webm' AND video_codec NOT IN ('vp9', 'av1')",
    "container-codec": f"kind = 'video' AND video_mode = 'compress' AND container IS NOT NULL AND container <> 'source' AND NOT {_VIDEO_TAKES}",
    "lossless-video": "kind = 'video' AND processing_mode IN ('lossless', 'strict-lossless') AND (video_mode <> 'copy' OR video_resolution <> 'original')",
    "audio-options": f"kind = 'audio' AND NOT {_AUDIO_OK}",
    "lossless-audio": f"kind = 'audio' AND {_AUDIO_OK} AND audio_mode IN ('lossless', 'strict-lossless') AND audio_format NOT IN ('flac', 'wav')",
    "audio-item-format": f"kind = 'audio' AND item_format IS NOT NULL AND item_format NOT IN {_AUDIOS}",
    "target-options": "processing_mode = 'target-size' AND NOT (target_enabled AND (target_bytes IS NOT NULL) <> (target_ratio IS NOT NULL) AND (target_bytes IS NULL OR target_bytes > 0))",
}
AUDIT_SQL = "\n  UNION ALL ".join(
    f"SELECT batch_id, '{name}' AS rule FROM s WHERE status <> 'complete' AND {cond.replace('{{', '{').replace('}}', '}')}"
    for name, cond in RULES_SQL.items()
)


@register(
    "p2_audit_settings",
    sql_over(
        ["media_files"],
        f"""WITH s AS (SELECT *, coalesce(item_format, video_container) AS container FROM ({SETTINGS.sql()})),
r AS ({AUDIT_SQL})
SELECT batch_id, rule, count(*) AS items FROM r GROUP BY batch_id, rule
UNION ALL SELECT batch_id, 'no-items', 0 FROM s GROUP BY batch_id HAVING bool_and(status = 'complete')""",
    ),
)
def audit_settings(spark, sf_dir):
    return settings_ops.audit_settings(SETTINGS.frame(spark, sf_dir))


TARGET_OPTIONS = Derived(
    ["media_files"],
    """SELECT file_id, file_id % 47 <> 0 OR NULL AS target_enabled, CASE file_id % 9 WHEN 0 THEN 'email' WHEN 1 THEN 'social' WHEN 2 THEN 'website' WHEN 3 THEN 'smartphone' WHEN 4 THEN 'cloud'
    WHEN 5 THEN 'half' WHEN 6 THEN 'under-100mb' WHEN 7 THEN 'custom' ELSE 'fax' END AS target_preset,
  CASE WHEN file_id % 2 = 0 THEN CASE WHEN file_id % 26 = 0 THEN 0 WHEN file_id % 34 = 0 THEN 9007199254740992 ELSE size_bytes END END AS target_bytes,
  CASE WHEN file_id % 2 = 1 OR file_id % 38 = 0 THEN CASE WHEN file_id % 21 = 0 THEN 1.5e0 ELSE 0.5e0 END END AS target_ratio,
  CASE file_id % 5 WHEN 0 THEN 'KB' WHEN 1 THEN 'MB' WHEN 2 THEN 'GB' WHEN 3 THEN 'MB' END AS target_unit,
  CASE file_id % 6 WHEN 0 THEN 'auto' WHEN 1 THEN '320' WHEN 2 THEN '64' WHEN 3 THEN 'remove' WHEN 4 THEN '128' ELSE '48' END AS target_audio,
  CASE WHEN file_id % 31 <> 0 THEN file_id % 2 = 0 END AS allow_resolution_change, CASE WHEN file_id % 37 <> 0 THEN file_id % 3 = 0 END AS allow_lossy_png,
  CASE file_id % 4 WHEN 0 THEN '#FFfF00' WHEN 1 THEN '#fff' END AS target_background, CAST(file_id % 104 AS INT) AS floor_jpeg, CAST(file_id % 101 AS INT) AS floor_webp,
  CASE WHEN file_id % 29 <> 0 THEN 45 END AS floor_avif, CASE file_id % 3 WHEN 0 THEN 480 WHEN 1 THEN 2160 ELSE 360 END AS floor_height,
  CASE file_id % 4 WHEN 0 THEN 64 WHEN 1 THEN 320 WHEN 2 THEN 48 ELSE 128 END AS floor_kbps, CASE file_id % 7 WHEN 0 THEN 'fast' WHEN 1 THEN 'turbo' WHEN 2 THEN 'maximum-compression' END AS target_speed
FROM {media_files}""",
)
TARGET_RULES_SQL = {
    "enabled": "target_enabled IS NULL",
    "preset": "target_preset = 'fax'",
    "bytes": "target_bytes <= 0 OR target_bytes > 9007199254740991",
    "ratio": "target_ratio <= 0 OR target_ratio > 1",
    "one-target": "(target_bytes IS NULL) = (target_ratio IS NULL)",
    "unit": "target_unit IS NULL",
    "audio": "target_audio NOT IN ('auto', '320', '256', '192', '128', '96', '64', 'remove')",
    "resolution-change": "allow_resolution_change IS NULL",
    "lossy-png": "allow_lossy_png IS NULL",
    "background": "NOT regexp_matches(target_background, '(?i)^#[0-9a-f]{6}$')",
    "floor-jpeg": "floor_jpeg NOT BETWEEN 1 AND 100",
    "floor-webp": "floor_webp NOT BETWEEN 1 AND 100",
    "floor-avif": "floor_avif IS NULL",
    "floor-height": "floor_height NOT IN (480, 720, 1080, 1440, 2160)",
    "floor-kbps": "floor_kbps NOT IN (64, 96, 128, 192, 256, 320)",
    "speed": "target_speed NOT IN ('fast', 'balanced', 'maximum-compression')",
}
_BROKEN = ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for name, cond in TARGET_RULES_SQL.items())


@register(
    "p2_target_options",
    sql_over(["media_files"], f"WITH o AS ({TARGET_OPTIONS.sql()}) SELECT file_id, concat_ws(',', {_BROKEN}) AS broken FROM o"),
)
def target_options(spark, sf_dir):
    checked = settings_ops.audit_target_options(TARGET_OPTIONS.frame(spark, sf_dir))
    return checked.select("file_id", F.array_join("broken", ",").alias("broken"))


CONFLICTS = Derived(
    ["media_files"],
    """SELECT file_id, kind, CASE file_id % 3 WHEN 0 THEN 'lossless' WHEN 1 THEN 'strict-lossless' ELSE 'reduce-size' END AS processing_mode, file_id % 7 = 0 AS enhanced, file_id % 11 = 0 AS ai,
  CASE file_id % 8 WHEN 0 THEN 'webp' WHEN 1 THEN 'png' WHEN 2 THEN 'jpeg' WHEN 3 THEN 'flac' WHEN 4 THEN 'wav' WHEN 5 THEN 'tiff' WHEN 6 THEN 'mp3' ELSE 'avif' END AS item_format,
  CASE WHEN file_id % 5 = 0 THEN 'lossless' ELSE 'lossy' END AS image_encoding FROM {media_files}""",
)


@register(
    "p11_lossless_conflicts",
    sql_over(
        ["media_files"],
        f"""WITH s AS ({CONFLICTS.sql()}),
c AS (SELECT file_id, CASE WHEN processing_mode = 'reduce-size' THEN NULL WHEN kind = 'image' AND (enhanced OR ai) THEN 'LOSSLESS_SETTINGS_CONFLICT'
  WHEN kind = 'image' AND NOT (item_format IN ('png', 'tiff') OR (item_format IN ('webp', 'avif') AND image_encoding = 'lossless')) THEN 'LOSSLESS_OUTPUT_REQUIRED'
  WHEN kind = 'audio' AND item_format NOT IN ('flac', 'wav') THEN 'LOSSLESS_AUDIO_OUTPUT_REQUIRED' END AS conflict FROM s)
SELECT * FROM c WHERE conflict IS NOT NULL""",
    ),
)
def lossless_conflicts(spark, sf_dir):
    rows = settings_ops.lossless_conflict(CONFLICTS.frame(spark, sf_dir))
    return rows.filter(F.col("conflict").isNotNull()).select("file_id", "conflict")


ROUTES = Derived(
    ["media_files"],
    """SELECT file_id, kind, size_bytes, CASE WHEN file_id % 3 = 0 THEN CAST(200000000 AS BIGINT) END AS requested_bytes, file_id % 7 = 0 AS ai,
  CASE WHEN file_id % 2 = 0 THEN 'copy' ELSE 'compress' END AS video_mode, CASE WHEN file_id % 10 = 0 THEN '720' ELSE 'original' END AS video_resolution,
  CASE WHEN file_id % 14 = 0 THEN '30' WHEN file_id % 4 = 0 THEN 'original' END AS frame_rate, file_id % 16 = 0 AS enhanced,
  CASE file_id % 4 WHEN 0 THEN 'h264' WHEN 1 THEN 'h265' WHEN 2 THEN 'vp9' ELSE 'av1' END AS video_codec, CASE WHEN file_id % 5 = 3 AND file_id % 4 < 2 THEN 'hevc_qsv' END AS hardware_encoder
FROM {media_files}""",
)
ROUTE_SQL = f"""
s AS ({ROUTES.sql()}),
p AS (SELECT *, CASE WHEN size_bytes <= requested_bytes THEN 'return-original' WHEN kind = 'video' AND ai THEN 'ai-enhancement'
  WHEN kind = 'video' AND video_mode = 'copy' AND video_resolution = 'original' AND coalesce(frame_rate, 'original') = 'original' AND NOT enhanced THEN 'stream-copy'
  WHEN kind = 'video' AND hardware_encoder IS NOT NULL THEN 'hardware-encode' WHEN kind = 'video' THEN 'software-encode' WHEN ai THEN 'ai-processing' ELSE 'image-optimization' END AS path
  FROM s WHERE kind IN ('image', 'video')),
q AS (SELECT *, CASE path WHEN 'hardware-encode' THEN hardware_encoder WHEN 'software-encode' THEN
  CASE video_codec WHEN 'h264' THEN 'libx264' WHEN 'h265' THEN 'libx265' WHEN 'vp9' THEN 'libvpx-vp9' ELSE 'libaom-av1' END END AS encoder FROM p)"""


@register("p3_route_files", sql_over(["media_files"], f"WITH {ROUTE_SQL.strip()} SELECT file_id, path, encoder FROM q"))
def route_files(spark, sf_dir):
    return settings_ops.route_files(ROUTES.frame(spark, sf_dir)).select("file_id", "path", "encoder")


@register(
    "p3_route_counts",
    sql_over(["media_files"], f"WITH {ROUTE_SQL.strip()} SELECT kind, path, encoder, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM q GROUP BY ALL"),
)
def route_counts(spark, sf_dir):
    return settings_ops.route_counts(settings_ops.route_files(ROUTES.frame(spark, sf_dir)))


FLOW = Derived(
    ["media_files"],
    """SELECT file_id, CASE file_id % 6 WHEN 0 THEN 'a.MOV' WHEN 1 THEN 'b.mp4' WHEN 2 THEN 'c.webm' WHEN 3 THEN 'd.mkv' WHEN 4 THEN 'e.avi' ELSE 'f' END AS name,
  CASE file_id % 5 WHEN 2 THEN 'mov,mp4,m4a,3gp,3g2,mj2' WHEN 3 THEN CASE WHEN file_id % 2 = 0 THEN 'Matroska' ELSE 'matroska,webm' END ELSE 'avi' END AS format_name,
  CASE file_id % 4 WHEN 0 THEN 'h264' WHEN 1 THEN 'HEVC' WHEN 2 THEN 'vp9' ELSE 'mpeg4' END AS video_source_codec,
  CASE file_id % 7 WHEN 0 THEN 'aac' WHEN 1 THEN 'opus' WHEN 2 THEN 'pcm_s16le' WHEN 3 THEN 'vorbis' WHEN 4 THEN 'mp3' END AS audio_source_codec,
  CASE file_id % 8 WHEN 0 THEN 'source' WHEN 1 THEN 'mp4' WHEN 2 THEN 'webm' WHEN 3 THEN 'mkv' WHEN 4 THEN 'mov' END AS selected_container,
  file_id % 3 = 0 AS reencode, CASE file_id % 4 WHEN 0 THEN 'vp9' WHEN 1 THEN 'h264' WHEN 2 THEN 'av1' ELSE 'h265' END AS video_codec, file_id % 2 = 0 AS copy_audio
FROM {media_files} WHERE kind = 'video'""",
)
FLOW_SQL = f"""
s AS ({FLOW.sql()}),
n AS (SELECT *, string_split(lower(format_name), ',') AS names FROM s),
c AS (SELECT *, CASE WHEN list_contains(names, 'webm') THEN 'webm' WHEN list_contains(names, 'matroska') AND lower(name) LIKE '%.webm' THEN 'webm' WHEN list_contains(names, 'matroska') THEN 'mkv'
  WHEN (list_contains(names, 'mov') OR list_contains(names, 'mp4')) AND lower(name) LIKE '%.mov' THEN 'mov' WHEN list_contains(names, 'mov') OR list_contains(names, 'mp4') THEN 'mp4' ELSE 'mkv' END AS source_container FROM n),
o AS (SELECT *, coalesce(nullif(coalesce(selected_container, 'source'), 'source'), CASE WHEN reencode THEN CASE WHEN video_codec IN ('vp9', 'av1') THEN 'webm' ELSE 'mp4' END ELSE source_container END) AS output_container FROM c),
k AS (SELECT *, output_container = 'mkv' OR (output_container = 'webm' AND lower(video_source_codec) IN ('vp8', 'vp9', 'av1')) OR (output_container = 'mp4' AND lower(video_source_codec) IN ('h264', 'hevc', 'h265', 'av1'))
    OR (output_container = 'mov' AND lower(video_source_codec) IN ('h264', 'hevc', 'h265')) AS v_ok,
  audio_source_codec IS NULL OR output_container = 'mkv' OR (output_container = 'webm' AND audio_source_codec IN ('opus', 'vorbis')) OR (output_container = 'mp4' AND audio_source_codec = 'aac')
    OR (output_container = 'mov' AND (audio_source_codec = 'aac' OR audio_source_codec LIKE 'pcm\\_%' ESCAPE '\\')) AS a_ok FROM o),
f AS (SELECT *, (NOT reencode AND (NOT v_ok OR NOT a_ok)) OR (reencode AND copy_audio AND NOT a_ok) AS incompatible FROM k)"""


@register(
    "p6_container_flow",
    sql_over(["media_files"], f"WITH {FLOW_SQL.strip()} SELECT file_id, source_container, output_container, incompatible FROM f"),
)
def container_flow(spark, sf_dir):
    return settings_ops.container_flow(FLOW.frame(spark, sf_dir)).select(
        "file_id", "source_container", "output_container", "incompatible"
    )


@register(
    "p6_flow_matrix",
    sql_over(["media_files"], f"WITH {FLOW_SQL.strip()} SELECT source_container, output_container, count(*) AS files, count(*) FILTER (incompatible) AS incompatible_files FROM f GROUP BY ALL"),
)
def flow_matrix(spark, sf_dir):
    return settings_ops.flow_matrix(settings_ops.container_flow(FLOW.frame(spark, sf_dir)))


COPIES = Derived(
    ["media_files"],
    """SELECT file_id, kind, CASE WHEN kind = 'audio' THEN CASE file_id % 8 WHEN 0 THEN 'mp3' WHEN 1 THEN 'mov,mp4,m4a' WHEN 2 THEN 'aac' WHEN 3 THEN 'ogg' WHEN 4 THEN 'opus' WHEN 5 THEN 'flac' WHEN 6 THEN 'wav' ELSE 'avi' END
    ELSE CASE file_id % 7 WHEN 0 THEN 'matroska,webm' WHEN 1 THEN 'Matroska' WHEN 2 THEN 'mov, mp4' WHEN 3 THEN 'avi' WHEN 4 THEN 'mpegts' WHEN 5 THEN 'ogg' ELSE 'flv' END END AS format_name,
  CASE file_id % 5 WHEN 0 THEN 'mp3' WHEN 1 THEN 'aac' WHEN 2 THEN 'opus' WHEN 3 THEN 'vorbis' ELSE CASE WHEN file_id % 2 = 0 THEN 'flac' ELSE 'pcm_s16le' END END AS codec,
  'clip.' || CASE file_id % 6 WHEN 0 THEN 'OGG' WHEN 1 THEN 'mp4' WHEN 2 THEN 'webm' WHEN 3 THEN 'dat' WHEN 4 THEN 'm2ts' ELSE 'x' END AS name FROM {media_files}""",
)


@register(
    "p6_copy_formats",
    sql_over(
        ["media_files"],
        f"""WITH c AS ({COPIES.sql()})
SELECT file_id, CASE WHEN kind <> 'audio' THEN NULL WHEN format_name = 'mp3' AND codec = 'mp3' THEN 'mp3' WHEN format_name LIKE 'mov%' AND codec = 'aac' THEN 'm4a' WHEN format_name = 'aac' AND codec = 'aac' THEN 'aac'
  WHEN format_name IN ('opus', 'ogg') AND codec = 'opus' THEN CASE WHEN name = 'clip.OGG' THEN 'ogg' ELSE 'opus' END WHEN format_name = 'ogg' AND codec = 'vorbis' THEN 'ogg'
  WHEN format_name = 'flac' AND codec = 'flac' THEN 'flac' WHEN format_name = 'wav' AND codec LIKE 'pcm%' THEN 'wav' END AS audio_format,
  CASE WHEN kind <> 'video' THEN NULL WHEN file_id % 6 = 1 THEN 'mp4' WHEN file_id % 6 = 2 THEN 'webm' WHEN file_id % 6 = 4 THEN 'm2ts'
  ELSE CASE file_id % 7 WHEN 0 THEN 'webm' WHEN 1 THEN 'mkv' WHEN 2 THEN 'mp4' WHEN 3 THEN 'avi' WHEN 4 THEN 'ts' WHEN 5 THEN 'ogv' ELSE 'mkv' END END AS strict_container FROM c""",
    ),
)
def copy_formats(spark, sf_dir):
    return settings_ops.copy_formats(COPIES.frame(spark, sf_dir)).select("file_id", "audio_format", "strict_container")


@register(
    "f1_units_and_labels",
    sql_over(
        [],
        """WITH v AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN -1.5e0 WHEN p_partkey % 7 = 1 THEN 0.0e0 WHEN p_partkey % 7 = 2 THEN 1.0e10 ELSE CAST(p_partkey AS DOUBLE) / 8 END AS value,
    CASE p_partkey % 4 WHEN 0 THEN 'KB' WHEN 1 THEN 'MB' WHEN 2 THEN 'GB' ELSE 'TB' END AS unit, p_partkey * 37 AS seconds FROM part),
b AS (SELECT *, value * CASE unit WHEN 'KB' THEN 1024 WHEN 'MB' THEN 1048576 WHEN 'GB' THEN 1073741824 END AS exact FROM v),
w AS (SELECT *, CASE WHEN value > 0 AND exact <= 9007199254740991 AND floor(exact + 0.5e0) > 0 THEN CAST(floor(exact + 0.5e0) AS BIGINT) END AS bytes FROM b)
SELECT id, bytes, CASE WHEN bytes IS NOT NULL THEN CAST(bytes AS DOUBLE) / CASE unit WHEN 'KB' THEN 1024 WHEN 'MB' THEN 1048576 WHEN 'GB' THEN 1073741824 END END AS back,
  CASE WHEN bytes < 1024 THEN printf('%d B', bytes) WHEN bytes < 1048576 THEN printf('%.1f KB', floor(CAST(bytes AS DOUBLE) / 1024 * 10 + 0.5e0) / 10)
    WHEN bytes < 1073741824 THEN printf('%.2f MB', floor(CAST(bytes AS DOUBLE) / 1048576 * 100 + 0.5e0) / 100) WHEN bytes IS NOT NULL THEN printf('%.2f GB', floor(CAST(bytes AS DOUBLE) / 1073741824 * 100 + 0.5e0) / 100) END AS size_label,
  CASE WHEN seconds >= 3600 THEN printf('%dh %dm %ds', seconds // 3600, seconds % 3600 // 60, seconds % 60) WHEN seconds >= 60 THEN printf('%dm %ds', seconds // 60, seconds % 60) ELSE printf('%ds', seconds) END AS elapsed_label,
  CASE WHEN seconds >= 3600 THEN printf('%d:%02d:%02d', seconds // 3600, seconds % 3600 // 60, seconds % 60) ELSE printf('%d:%02d', seconds // 60, seconds % 60) END AS time_label FROM w""",
    ),
)
def units_and_labels(spark, sf_dir):
    key = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        key.alias("id"),
        F.when(key % 7 == 0, -1.5).when(key % 7 == 1, 0.0).when(key % 7 == 2, 1.0e10).otherwise(key.cast("double") / 8).alias("value"),
        F.when(key % 4 == 0, "KB").when(key % 4 == 1, "MB").when(key % 4 == 2, "GB").otherwise("TB").alias("unit"),
        (key * 37).alias("seconds"),
    ).withColumn("bytes", size_in_bytes(F.col("value"), F.col("unit")))
    return rows.select(
        "id", "bytes", bytes_in_unit(F.col("bytes"), F.col("unit")).alias("back"), labels.byte_label(F.col("bytes")).alias("size_label"),
        labels.elapsed_label(F.col("seconds")).alias("elapsed_label"), labels.media_time_label(F.col("seconds")).alias("time_label"),
    )


def probe_documents(spark, sf_dir):
    """Probe JSON of every timed file, with gaps, attached pictures and broken documents."""
    c = F.col
    text = lambda x: x.cast("string")
    picture = F.struct(
        F.lit(0).alias("index"), F.lit("video").alias("codec_type"), F.lit("mjpeg").alias("codec_name"),
        F.lit(100).alias("width"), F.lit(100).alias("height"), F.lit(None).cast("string").alias("bit_rate"),
        F.lit(None).cast("string").alias("avg_frame_rate"), F.lit(None).cast("string").alias("pix_fmt"),
        F.struct(F.lit(1).alias("attached_pic")).alias("disposition"),
        F.create_map(F.lit("title"), F.lit("cover")).alias("tags"),
    )
    fps = F.when(c("fps") == 30, "30000/1001").when(c("fps") == 24, "24").otherwise("60/1")
    video = F.struct(
        F.lit(1).alias("index"), F.lit("video").alias("codec_type"),
        F.when(c("file_id") % 2 == 0, "hevc").otherwise("h264").alias("codec_name"),
        c("width").alias("width"), c("height").alias("height"),
        F.when(c("file_id") % 3 != 0, text(c("size_bytes") % 9000000 + 1)).otherwise("N/A").alias("bit_rate"),
        F.when(c("file_id") % 4 == 0, "0/0").otherwise(fps).alias("avg_frame_rate"),
        F.when(c("file_id") % 5 == 2, "yuv420p10le").otherwise("yuv420p").alias("pix_fmt"),
        F.struct(F.lit(0).alias("attached_pic")).alias("disposition"),
        F.create_map(F.lit("rotate"), F.when(c("file_id") % 6 == 0, "90").otherwise("none")).alias("tags"),
    )
    audio = F.transform(
        F.sequence(F.lit(1), c("audio_track_count")),
        lambda i: F.struct(
            (i + 1).alias("index"), F.lit("audio").alias("codec_type"),
            F.when(i % 2 == 1, "aac").otherwise("opus").alias("codec_name"),
            F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
            text(i * 1000 + c("file_id") % 100000).alias("bit_rate"),
            F.lit(None).cast("string").alias("avg_frame_rate"), F.lit(None).cast("string").alias("pix_fmt"),
            F.struct(F.lit(0).alias("attached_pic")).alias("disposition"),
            F.create_map(F.lit("language"), F.lit("eng")).alias("tags"),
        ),
    )
    none = F.array().cast(
        "array<struct<index:int,codec_type:string,codec_name:string,width:int,height:int,bit_rate:string,"
        "avg_frame_rate:string,pix_fmt:string,disposition:struct<attached_pic:int>,tags:map<string,string>>>"
    )
    streams = F.concat(
        F.array(picture),
        F.when(c("kind") == "video", F.array(video)).otherwise(none),
        F.when(c("audio_track_count") > 0, audio).otherwise(none),
    )
    document = F.struct(
        streams.alias("streams"),
        F.when(c("file_id") % 5 == 3, F.array(F.struct(F.lit(1).alias("id")))).alias("chapters"),
        F.struct(
            F.lit("matroska,webm").alias("format_name"),
            F.when(c("file_id") % 31 != 0, text(c("duration_s"))).alias("duration"),
            F.when(c("file_id") % 43 == 0, "0").otherwise(text(c("size_bytes"))).alias("size"),
            F.when(c("file_id") % 2 == 1, text(c("size_bytes") % 1000000 + 1)).alias("bit_rate"),
        ).alias("format"),
    )
    raw = F.when(c("file_id") % 53 == 0, F.lit("not json")).otherwise(F.to_json(document))
    return view(spark, sf_dir, "media_files").filter("duration_s > 0").select(
        "file_id", "size_bytes", raw.alias("raw")
    )


# The same facts, computed without documents.
PROBE_SQL = f"""
m AS (SELECT *, file_id % 53 = 0 AS broken, kind = 'video' AS is_video FROM media_files WHERE duration_s > 0),
p AS (SELECT *, CASE WHEN is_video AND file_id % 3 <> 0 THEN CAST(size_bytes % 9000000 + 1 AS DOUBLE) END AS v_bits,
  CASE WHEN audio_track_count > 0 THEN CAST(1000 + file_id % 100000 AS DOUBLE) END AS a_bits,
  CASE WHEN is_video AND file_id % 4 <> 0 THEN CASE WHEN fps = 30 THEN {sql_fixed('(30000.0e0 / 1001)', 3)} ELSE fps END END AS rate,
  CASE WHEN file_id % 2 = 1 THEN CAST(size_bytes % 1000000 + 1 AS DOUBLE) END AS f_bits FROM m)"""


@register(
    "s4_parse_probes",
    sql_over(
        ["media_files"],
        f"""WITH {PROBE_SQL.strip()}
SELECT file_id, CASE WHEN broken THEN 'MEDIA_PROBE_FAILED' WHEN file_id % 31 = 0 OR (NOT is_video AND audio_track_count = 0) THEN 'MEDIA_INFO_INCOMPLETE' END AS reject_reason,
  CASE WHEN NOT broken AND is_video THEN 'video' ELSE 'audio' END AS kind, CASE WHEN NOT broken AND file_id % 31 <> 0 THEN duration_s END AS duration_s,
  CASE WHEN NOT broken THEN coalesce(f_bits, v_bits, a_bits) END AS bitrate, CASE WHEN NOT broken AND file_id % 5 = 3 THEN 1 ELSE 0 END AS chapter_count,
  CAST(CASE WHEN NOT broken AND is_video THEN height END AS INTEGER) AS height, CASE WHEN NOT broken AND is_video THEN CASE WHEN file_id % 2 = 0 THEN 'hevc' ELSE 'h264' END END AS video_codec,
  CASE WHEN NOT broken THEN rate END AS fps, CASE WHEN NOT broken AND is_video THEN file_id % 5 = 2 END AS hdr,
  CASE WHEN NOT broken AND is_video AND file_id % 6 = 0 THEN 90.0e0 END AS rotation,
  CASE WHEN NOT broken AND audio_track_count > 0 THEN 'aac' END AS audio_codec, CAST(CASE WHEN broken THEN 0 ELSE audio_track_count END AS INTEGER) AS audio_track_count,
  CAST(CASE WHEN broken THEN 0 ELSE 1 + CASE WHEN is_video THEN 1 ELSE 0 END + audio_track_count END AS INTEGER) AS streams
FROM p""",
    ),
)
def parse_probes(spark, sf_dir):
    parsed = probes.parse_probes(probe_documents(spark, sf_dir).drop("size_bytes"))
    return parsed.select(
        "file_id", "reject_reason", "kind", "duration_s", "bitrate", "chapter_count",
        F.col("video.height").alias("height"), F.col("video.codec").alias("video_codec"),
        F.col("video.fps").alias("fps"), F.col("video.hdr").alias("hdr"),
        F.col("video.rotation").alias("rotation"), F.col("audio.codec").alias("audio_codec"),
        "audio_track_count", F.size("streams").alias("streams"),
    )


@register(
    "s5_parse_target_probes",
    sql_over(
        ["media_files"],
        f"""WITH {PROBE_SQL.strip()},
t AS (SELECT *, audio_track_count * (audio_track_count + 1) / 2 * 1000 + audio_track_count * (file_id % 100000) AS total_audio FROM p)
SELECT file_id, CASE WHEN broken THEN 'TARGET_SIZE_PROBE_FAILED' WHEN file_id % 31 = 0 THEN 'ZERO_DURATION' WHEN file_id % 43 = 0 THEN 'EMPTY_FILE' END AS reject_reason,
  CASE WHEN broken OR file_id % 31 = 0 THEN 0.0e0 ELSE duration_s END AS duration_s, CASE WHEN broken OR file_id % 43 = 0 THEN 0 ELSE size_bytes END AS size_bytes,
  CAST(CASE WHEN NOT broken THEN floor(f_bits / 1000 + 0.5e0) END AS BIGINT) AS total_kbps,
  CAST(CASE WHEN NOT broken AND audio_track_count > 0 THEN floor(CAST(total_audio AS DOUBLE) / 1000 + 0.5e0) END AS BIGINT) AS audio_kbps,
  CASE WHEN broken THEN NULL ELSE 'mjpeg' END AS video_codec, CASE WHEN broken THEN '' ELSE array_to_string(list_transform(generate_series(1, CAST(audio_track_count AS BIGINT)), lambda i: CASE WHEN i % 2 = 1 THEN 'aac' ELSE 'opus' END), ',') END AS audio_codecs,
  CAST(CASE WHEN broken THEN 0 ELSE audio_track_count END AS INTEGER) AS audio_track_count
FROM t""",
    ),
)
def parse_target_probes(spark, sf_dir):
    parsed = probes.parse_target_probes(probe_documents(spark, sf_dir).drop("size_bytes"))
    return parsed.select(
        "file_id", "reject_reason", "duration_s", "size_bytes", "total_kbps", "audio_kbps",
        "video_codec", F.array_join("audio_codecs", ",").alias("audio_codecs"), "audio_track_count",
    )


@register(
    "s6_target_probe_from_inspection",
    sql_over(
        ["media_files"],
        f"""WITH {PROBE_SQL.strip()}
SELECT file_id, kind, duration_s, size_bytes, CASE WHEN coalesce(f_bits, v_bits, a_bits) IS NOT NULL THEN CAST(greatest(1, floor(coalesce(f_bits, v_bits, a_bits) / 1000 + 0.5e0)) AS BIGINT) END AS total_kbps,
  CASE WHEN v_bits IS NOT NULL THEN CAST(greatest(1, floor(v_bits / 1000 + 0.5e0)) AS BIGINT) END AS video_kbps,
  CASE WHEN a_bits IS NOT NULL THEN CAST(greatest(1, floor(a_bits / 1000 + 0.5e0)) AS BIGINT) END AS audio_kbps, CAST(CASE WHEN is_video THEN height END AS INTEGER) AS height, rate AS fps,
  array_to_string(list_transform(generate_series(1, CAST(audio_track_count AS BIGINT)), lambda i: CASE WHEN i % 2 = 1 THEN 'aac' ELSE 'opus' END), ',') AS audio_codecs, CAST(audio_track_count AS INTEGER) AS audio_track_count
FROM p WHERE NOT broken AND file_id % 31 <> 0 AND (is_video OR audio_track_count > 0)""",
    ),
)
def target_probe_from_inspection(spark, sf_dir):
    documents = probe_documents(spark, sf_dir)
    parsed = probes.parse_probes(documents.drop("size_bytes")).filter("reject_reason IS NULL")
    sized = parsed.join(documents.select("file_id", "size_bytes"), "file_id")
    return probes.target_probe_from_inspection(sized).select(
        "file_id", "kind", "duration_s", "size_bytes", "total_kbps", "video_kbps", "audio_kbps",
        "height", "fps", F.array_join("audio_codecs", ",").alias("audio_codecs"), "audio_track_count",
    )


@register(
    "s6_optimization_probe",
    sql_over(
        ["media_files"],
        f"""WITH {PROBE_SQL.strip()} SELECT file_id, duration_s, CAST(height AS INTEGER) AS height, rate AS fps, file_id % 5 = 2 AS hdr, CASE WHEN file_id % 5 = 3 THEN 1 ELSE 0 END AS chapter_count
FROM p WHERE NOT broken AND file_id % 31 <> 0 AND is_video""",
    ),
)
def optimization_probe(spark, sf_dir):
    documents = probe_documents(spark, sf_dir)
    parsed = probes.parse_probes(documents.drop("size_bytes")).filter("reject_reason IS NULL")
    sized = parsed.join(documents.select("file_id", "size_bytes"), "file_id")
    return probes.optimization_probe_from_inspection(sized).select(
        "file_id", "duration_s", "height", "fps", "hdr", "chapter_count"
    )


@register(
    "s4_media_streams",
    sql_over(
        ["media_files"],
        f"""WITH {PROBE_SQL.strip()}, ok AS (SELECT * FROM p WHERE NOT broken AND file_id % 31 <> 0 AND (is_video OR audio_track_count > 0)),
s AS (SELECT 'video' AS type, 'mjpeg' AS codec, true AS is_attached_picture FROM ok UNION ALL SELECT 'video', CASE WHEN file_id % 2 = 0 THEN 'hevc' ELSE 'h264' END, false FROM ok WHERE is_video
  UNION ALL SELECT 'audio', CASE WHEN i % 2 = 1 THEN 'aac' ELSE 'opus' END, false FROM (SELECT unnest(generate_series(1, CAST(audio_track_count AS BIGINT))) AS i FROM ok))
SELECT type, codec, is_attached_picture, count(*) AS streams FROM s GROUP BY ALL""",
    ),
)
def media_streams(spark, sf_dir):
    parsed = probes.parse_probes(probe_documents(spark, sf_dir).drop("size_bytes"))
    return probes.media_streams(parsed).groupBy("type", "codec", "is_attached_picture").agg(
        F.count(F.lit(1)).alias("streams")
    )


DOCUMENTS = Derived(
    ["orders"],
    """SELECT o_orderkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS job_id,
  CASE WHEN o_orderkey % 7 = 0 THEN 'elsewhere' ELSE 'same' END AS owner, CASE WHEN o_orderkey % 11 = 0 THEN '../out.mp4' ELSE 'out.mp4' END AS output_name
FROM (SELECT o_orderkey, md5(CAST(o_orderkey AS STRING)) AS h FROM {orders}) q""",
)


@register(
    "s2_job_documents",
    sql_over(
        [],
        f"WITH d AS ({DOCUMENTS.sql()}) SELECT job_id, output_name FROM d WHERE owner = 'same' AND output_name = 'out.mp4' AND o_orderkey % 13 <> 0",
    ),
)
def job_documents(spark, sf_dir):
    rows = DOCUMENTS.frame(spark, sf_dir)
    folder = F.when(F.col("o_orderkey") % 13 == 0, "not-a-job").otherwise(F.col("job_id"))
    owner = F.when(F.col("owner") == "same", folder).otherwise(F.col("owner"))
    document = F.to_json(F.struct(owner.alias("jobId"), F.col("output_name").alias("outputName")))
    texts = rows.select(
        F.concat(F.lit("file:/jobs/"), folder, F.lit("/manifest.json")).alias("path"),
        document.alias("document"),
    )
    kept = file_sources.job_documents(texts, "manifest")
    return kept.select("job_id", F.get_json_object("document", "$.outputName").alias("output_name"))
