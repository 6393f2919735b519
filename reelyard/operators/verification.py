"""Output verification: streams, formats, metadata, removals, errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims


def _fine(rows: DataFrame) -> int:
    """Partitions for rows that tasks keep in tables or sort: four for each usual one."""
    return 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _counted(before: DataFrame, after: DataFrame) -> DataFrame:
    """Stream hashes of each file with their number on either side.

    Hashes are trimmed; blank ones and comments (``#``) don't count. Both sides are counted in
    one pass. Nearly all hashes differ, so rows are dealt out before they are counted: the
    table of a task is bounded by its share of the shuffle, not by the split that it scans.
    """
    file_id, zero, one = F.col("file_id"), F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    sides = [
        # rows without a file have no counterpart
        side.select("file_id", F.trim("hash").alias("hash"), F.when(file_id.isNull(), i).alias("__apart"), a.alias("a"), b.alias("b"))
        for i, (side, a, b) in enumerate(((before, one, zero), (after, zero, one)))
    ]
    rows = sides[0].unionByName(sides[1]).filter((F.col("hash") != "") & ~F.startswith("hash", F.lit("#")))
    keys = ["file_id", "hash", "__apart"]
    return rows.repartition(_fine(rows), "file_id", "hash").groupBy(*keys).agg(F.sum("a").alias("a"), F.sum("b").alias("b")).drop("__apart")


def verify_streams(before: DataFrame, after: DataFrame) -> DataFrame:
    """Whether input and output have the same, non-empty multiset of stream hashes.

    ``file_id, hash`` on both sides.
    """
    a, b, zero = F.col("a"), F.col("b"), F.lit(0)
    return _counted(before, after).groupBy("file_id").agg(
        F.sum(a).alias("input_streams"),
        F.sum(b).alias("output_streams"),
        F.sum(F.greatest(a - b, zero)).alias("missing_streams"),
        F.sum(F.greatest(b - a, zero)).alias("extra_streams"),
        (F.bool_and(a == b) & (F.sum(a) > 0)).alias("verified"),
    )


def stream_differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """Hashes on one side only, with multiplicity, as rows; the same hashes count as above."""
    surplus = _counted(before, after).filter("a <> b").select(
        "file_id", "hash", F.when(F.col("a") > F.col("b"), "missing").otherwise("extra").alias("side"),
        F.abs(F.col("a") - F.col("b")).alias("times"),
    )
    return surplus.select("file_id", "hash", "side", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int")))).drop("col")


def _allowed_names(kind: Column, requested: Column) -> Column:
    expr = None
    for category, value, names in dims.PROBED_FORMAT_NAMES:
        hit = (kind == category) & (requested == value)
        allowed = F.array(*[F.lit(n) for n in names])
        expr = F.when(hit, allowed) if expr is None else expr.when(hit, allowed)
    return expr


def verify_outputs(requested: DataFrame, probed: DataFrame) -> DataFrame:
    """Violation code of each output, null when it matches.

    ``requested``: file_id, kind, output_format, codec (null: not re-encoded).
    ``probed``: file_id, format_name, probed_codec, output_bytes.
    """
    c = F.col
    rows = requested.join(probed, "file_id", "left")
    names = F.split(F.lower(c("format_name")), ",")
    format_ok = F.coalesce(
        F.arrays_overlap(names, _allowed_names(c("kind"), c("output_format"))), F.lit(False)
    )
    actual = c("probed_codec")
    video_ok = F.when(c("codec") == "h265", actual.isin("hevc", "h265")).otherwise(actual == c("codec"))
    expected_audio = (
        F.when(c("output_format").isin("m4a", "aac"), "aac")
        .when(c("output_format") == "ogg", "vorbis")
        .otherwise(c("output_format"))
    )
    audio_ok = F.when(
        c("output_format") == "wav", F.startswith(actual, F.lit("pcm_"))
    ).otherwise(actual == expected_audio)
    codec_ok = F.when(c("kind") == "video", c("codec").isNull() | video_ok).otherwise(audio_ok)
    code = (
        F.when(c("output_bytes").isNull(), "NO_OUTPUT")
        .when(c("output_bytes") <= 0, "EMPTY_OUTPUT")
        .when(~format_ok, "OUTPUT_FORMAT_MISMATCH")
        .when(~F.coalesce(codec_ok, F.lit(False)), "OUTPUT_CODEC_MISMATCH")
    )
    return rows.withColumn("violation", code)


PRIVACY_GROUPS = ("exif", "xmp", "iptc")


def verify_metadata(before: DataFrame, after: DataFrame, policy: DataFrame) -> DataFrame:
    """Whether display metadata survived and privacy metadata was treated as asked.

    ``before``/``after``: file_id, grp (icc, density, exif, xmp, iptc), digest.
    ``policy``: file_id, strip_privacy, same_format.
    """
    sides = before.select("file_id", "grp", F.col("digest").alias("a")).join(
        after.select("file_id", "grp", F.col("digest").alias("b")), ["file_id", "grp"], "full_outer"
    )
    rows = sides.join(policy, "file_id")
    grp, a, b = F.col("grp"), F.col("a"), F.col("b")
    private = grp.isin(*PRIVACY_GROUPS)
    changed = ~a.eqNullSafe(b)
    issue = (
        F.when((grp == "icc") & a.isNotNull() & changed, 1)
        .when((grp == "density") & F.col("same_format") & a.isNotNull() & changed, 2)
        .when(private & F.col("strip_privacy") & b.isNotNull(), 3)
        .when(private & ~F.col("strip_privacy") & changed, 4)
    )
    worst = rows.groupBy("file_id").agg(F.min(issue).alias("__issue"))
    reason = (
        F.when(F.col("__issue") == 1, "icc-lost")
        .when(F.col("__issue") == 2, "density-lost")
        .when(F.col("__issue") == 3, "privacy-left")
        .when(F.col("__issue") == 4, "metadata-changed")
        .otherwise("kept")
    )
    # Files without any metadata group have nothing to lose.
    return policy.select("file_id").join(worst, "file_id", "left").select(
        "file_id", F.col("__issue").isNull().alias("passed"), reason.alias("reason")
    )


def removed_types(before: DataFrame, after: DataFrame) -> DataFrame:
    """Metadata types present before and absent after (``file_id, types`` arrays)."""
    rows = before.join(after.withColumnRenamed("types", "__after"), "file_id", "left")
    return rows.select(
        "file_id",
        F.array_except("types", F.coalesce("__after", F.array().cast("array<string>"))).alias("removed"),
    )


def removal_items(streams: DataFrame, files: DataFrame) -> DataFrame:
    """What a stream selection would remove: ``file_id, category, detail`` rows.

    ``streams``: file_id, idx, type, is_attached_picture, title, language, filename.
    ``files``: file_id, chapter_count, format_tags (map), keep_primary_audio,
    remove_subtitles, remove_attachments, remove_chapters, strip_privacy.
    """
    c = F.col
    first_audio = (
        streams.filter(c("type") == "audio").groupBy("file_id").agg(F.min("idx").alias("__first"))
    )
    options = files.select(
        "file_id", "keep_primary_audio", "remove_subtitles", "remove_attachments"
    ).join(first_audio, "file_id", "left")
    rows = streams.join(options, "file_id")
    label = F.concat(F.lit("#"), c("idx").cast("string"))
    audio = (c("type") == "audio") & (c("idx") > c("__first")) & c("keep_primary_audio")
    subtitle = (c("type") == "subtitle") & c("remove_subtitles")
    attachment = ((c("type") == "attachment") | c("is_attached_picture")) & c("remove_attachments")
    hits = F.array_compact(
        F.array(
            F.when(audio, F.struct(F.lit("audio").alias("category"), F.coalesce("title", label).alias("detail"))),
            F.when(
                subtitle,
                F.struct(
                    F.lit("subtitle").alias("category"),
                    F.coalesce("title", "language", label).alias("detail"),
                ),
            ),
            F.when(
                attachment,
                F.struct(
                    F.lit("attachment").alias("category"),
                    F.coalesce("filename", "title", label).alias("detail"),
                ),
            ),
        )
    )
    from_streams = rows.select("file_id", F.inline(hits))
    tags = files.filter(c("strip_privacy")).select(
        "file_id", F.lit("metadata").alias("category"), F.explode(F.map_keys("format_tags")).alias("detail")
    )
    return from_streams.unionByName(tags)


def removal_counts(streams: DataFrame, files: DataFrame) -> DataFrame:
    """Removed streams, chapters and tags per file and category."""
    counted = removal_items(streams, files).groupBy("file_id", "category").agg(
        F.count(F.lit(1)).alias("items")
    )
    chapters = files.filter(F.col("remove_chapters") & (F.col("chapter_count") > 0)).select(
        "file_id", F.lit("chapter").alias("category"), F.col("chapter_count").cast("bigint").alias("items")
    )
    return counted.unionByName(chapters)


def removal_totals(counts: DataFrame, files: DataFrame) -> DataFrame:
    """Files and items per batch and category."""
    return (
        counts.join(files.select("file_id", "batch_id"), "file_id")
        .groupBy("batch_id", "category")
        .agg(F.count(F.lit(1)).alias("files"), F.sum("items").alias("items"))
    )


def classify_errors(errors: DataFrame) -> DataFrame:
    """HTTP status and retry flag of each error row (``code``)."""
    return errors.withColumns(
        {
            "http_status": F.coalesce(
                dims.lookup(F.col("code"), dims.ERROR_STATUS), F.lit(dims.DEFAULT_ERROR_STATUS)
            ),
            "retryable": F.coalesce(F.col("code").isin(*dims.RETRYABLE_ERRORS), F.lit(False)),
            "classified": F.coalesce(F.col("code").isin(*dims.ERROR_STATUS), F.lit(False)),
        }
    )


def error_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("code", "http_status", "retryable", "classified").agg(
        F.count(F.lit(1)).alias("errors")
    )


def metadata_report(tags: DataFrame, detected: DataFrame) -> DataFrame:
    """Reported tags of each file.

    ``tags``: file_id, pos, key, value. ``detected``: file_id, grp (EXIF, XMP, IPTC found
    in the file). Structural names are skipped, the first 24 others are kept, and of
    those the GPS tags and the tags of detected groups are shown.
    """
    named = tags.filter(F.col("value").isNotNull() & ~F.col("key").isin(*dims.STRUCTURAL_TAGS))
    order = Window.partitionBy("file_id").orderBy("pos")
    first = (
        named.withColumn("__rank", F.row_number().over(order))
        .filter(F.col("__rank") <= dims.MAX_REPORTED_TAGS)
        .drop("__rank")
    )
    grp = None
    for name, pattern in dims.TAG_GROUP_PATTERNS:
        hit = F.col("key").rlike(pattern)
        grp = F.when(hit, name) if grp is None else grp.when(hit, name)
    shown = first.withColumns(
        {"grp": grp.otherwise("EXIF"), "value": F.substring("value", 1, 180)}
    )
    # By file alone, as the tags already lie: they are shuffled once.
    known = detected.groupBy("file_id").agg(F.collect_set("grp").alias("__known"))
    rest = [c for c in shown.columns if c not in ("file_id", "grp")]
    return (
        shown.join(known, "file_id", "left")
        .filter((F.col("grp") == "GPS") | F.array_contains("__known", F.col("grp")))
        .select("file_id", "grp", *rest)
    )
