"""Intake rules: triage, safety scans, duplicates, admission, census, recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims

# --- fixed values: leading bytes of executables ----------------------------------
EXECUTABLE_PREFIXES = ("4D5A", "7F454C46", "FEEDFACE", "FEEDFACF", "CEFAEDFE", "CFFAEDFE", "CAFEBABE", "2321")
# --- fixed values: what makes an SVG unsafe --------------------------------------
UNSAFE_SVG = (
    ("doctype", r"(?i)<!DOCTYPE"),
    ("entity", r"(?i)<!ENTITY"),
    ("script", r"(?i)<script\b"),
    ("event-handler", r"(?i)\son[a-z]+\s*="),
    ("external-reference", r"""(?i)(?:href|xlink:href)\s*=\s*["']\s*(?:https?:|ftp:|file:)"""),
)
def is_executable(content: Column) -> Column:
    """First-bytes test for Windows, ELF, Mach-O and script files."""
    head = F.hex(F.substring(content, 1, 4))
    hit = F.lit(False)
    for prefix in EXECUTABLE_PREFIXES:
        hit = hit | F.startswith(head, F.lit(prefix))
    return hit


def classify_headers(files: DataFrame) -> DataFrame:
    """``path, length, content`` to ``path, size_bytes, executable``."""
    return files.select(
        "path", F.col("length").alias("size_bytes"), is_executable(F.col("content")).alias("executable")
    )


def scan_svg(documents: DataFrame) -> DataFrame:
    """One flag per reason and ``unsafe`` for each document ``id, content``."""
    text = F.col("content").cast("string")
    flags = {name.replace("-", "_"): text.rlike(pattern) for name, pattern in UNSAFE_SVG}
    flagged = documents.select("id", *[c.alias(n) for n, c in flags.items()])
    unsafe = F.lit(False)
    for name in flags:
        unsafe = unsafe | F.col(name)
    return flagged.withColumn("unsafe", unsafe)


def svg_reasons(scanned: DataFrame) -> DataFrame:
    """Documents per reason."""
    names = [n.replace("-", "_") for n, _ in UNSAFE_SVG]
    hits = F.array_compact(
        F.array(*[F.when(F.col(n), F.lit(r)) for n, (r, _) in zip(names, UNSAFE_SVG)])
    )
    return scanned.select(F.explode(hits).alias("reason")).groupBy("reason").agg(
        F.count(F.lit(1)).alias("documents")
    )


def duplicate_content(files: DataFrame) -> DataFrame:
    """Groups of files with identical content: digest, copies, bytes, first id.

    The digest is computed in the scan; only digests and counters are shuffled, and they
    combine map-side, so a huge group of copies stays one partial row per task.
    """
    hashed = files.select("id", F.sha2("content", 256).alias("digest"), "size_bytes")
    return (
        hashed.groupBy("digest")
        .agg(
            F.count(F.lit(1)).alias("copies"),
            F.sum("size_bytes").alias("total_bytes"),
            F.min("id").alias("first_id"),
            (F.sum("size_bytes") - F.min("size_bytes")).alias("duplicate_bytes"),
        )
        .filter(F.col("copies") > 1)
    )


def triage_intake(files: DataFrame) -> DataFrame:
    """Code of the first rule a file fails, or ACCEPTED. A file of unknown or null kind is one
    that nothing can decode.

    ``files``: kind, size_bytes, executable, width, height, pages, svg, unsafe_svg,
    signature_kind, duration_s.
    """
    size, width, height = F.col("size_bytes"), F.col("width"), F.col("height")
    image = F.col("kind") == "image"
    pixels = width.cast("bigint") * height
    edges = (width > dims.MAX_IMAGE_EDGE) | (height > dims.MAX_IMAGE_EDGE)
    code = (
        F.when(size == 0, "EMPTY_FILE")
        .when(size > dims.MAX_VIDEO_BYTES, "FILE_TOO_LARGE")
        .when(F.col("executable"), "EXECUTABLE_REJECTED")
        .when(F.coalesce("kind", F.lit("unknown")) == "unknown", "UNSUPPORTED_TYPE")
        .when(image & (edges | (pixels > dims.MAX_IMAGE_PIXELS)), "IMAGE_DIMENSIONS_TOO_LARGE")
        .when(
            image
            & ((F.col("pages") > dims.MAX_ANIMATION_FRAMES)
               | (pixels * F.col("pages") > dims.MAX_ANIMATION_PIXELS)),
            "ANIMATION_TOO_LARGE",
        )
        .when(image & F.col("svg") & (size > dims.MAX_SVG_BYTES), "SVG_TOO_LARGE")
        .when(image & F.col("svg") & F.col("unsafe_svg"), "UNSAFE_SVG")
        .when(image & (size > dims.MAX_IMAGE_BYTES), "FILE_TOO_LARGE")
        .when(image & (F.col("signature_kind") != "image"), "TYPE_MISMATCH")
        .when(~image & (F.col("duration_s") > dims.MAX_DURATION_S), "MEDIA_DURATION_TOO_LONG")
        .when((F.col("kind") == "audio") & (size > dims.MAX_AUDIO_BYTES), "FILE_TOO_LARGE")
        .when(
            (F.col("kind") == "video")
            & ((width > dims.MAX_VIDEO_WIDTH) | (height > dims.MAX_VIDEO_HEIGHT)),
            "VIDEO_DIMENSIONS_TOO_LARGE",
        )
        .otherwise("ACCEPTED")
    )
    return files.withColumn("code", code)


def triage_counts(triaged: DataFrame) -> DataFrame:
    return triaged.groupBy("kind", "code").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes")
    ).withColumn("http_status", dims.lookup(F.col("code"), dims.ERROR_STATUS | {"ACCEPTED": 200}))


def kind_of(mime: Column, name: Column) -> Column:
    """Kind by MIME type, then by extension."""
    expr = None
    for kind in ("image", "video", "audio"):
        hit = F.startswith(mime, F.lit(f"{kind}/"))
        expr = F.when(hit, kind) if expr is None else expr.when(hit, kind)
    ext = F.lower(F.substring_index(name, ".", -1))
    for kind, extensions in dims.KIND_EXTENSIONS.items():
        expr = expr.when(ext.isin(*extensions), kind)
    return expr.otherwise("unknown")


def kind_census(files: DataFrame) -> DataFrame:
    """Files and bytes per batch and kind: ``batch_id, name, mime, size_bytes``."""
    kind = kind_of(F.coalesce("mime", F.lit("")), F.col("name"))
    return files.withColumn("kind", kind).groupBy("batch_id", "kind").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes")
    )


def unknown_share(files: DataFrame) -> DataFrame:
    """Share of files without a known kind per batch, in percent."""
    kind = kind_of(F.coalesce("mime", F.lit("")), F.col("name"))
    return files.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(kind == "unknown").alias("unknown_files")
    )


def new_files(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """Incoming files whose (name, size, last modified) is not yet known."""
    return incoming.join(known, ["name", "size_bytes", "modified"], "left_anti")


def admit(files: DataFrame, limit: int = dims.MAX_FILES_PER_BATCH, most_bytes: int = dims.MAX_UPLOAD_BYTES) -> DataFrame:
    """Admission of each batch, with the reason of every rejection in ``outcome``.

    ``files``: batch_id, ord (unique within the batch), name, size_bytes, modified and, where
    known, mime. Files after the first ``limit`` of a batch are ``over-limit``, whatever they
    hold. Of the first ones those without bytes are ``empty`` (so is an unknown size), larger
    ones ``oversized``, programs by their type ``executable``; of the rest the first of each
    (name, size, modified) is ``admitted``, others are ``duplicate``. Nulls equal each other.

    Only ``limit`` rows of a batch are ever judged: a top-n with partial limits leaves them in
    one partition per batch. Their outcome goes back by an equi-join on (batch_id, ord), which
    no batch can skew.
    """
    size, mime = F.col("size_bytes"), F.col("mime") if "mime" in files.columns else F.lit(None)
    fault = (
        F.when(F.coalesce(size, F.lit(0)) <= 0, "empty")
        .when(size > most_bytes, "oversized")
        .when(F.coalesce(mime.rlike(dims.EXECUTABLE_MIME), F.lit(False)), "executable")
    )
    order = Window.partitionBy("batch_id").orderBy("ord")
    same = Window.partitionBy("batch_id", "name", "size_bytes", "modified", F.col("__fault").isNull()).orderBy("ord")
    judged = (
        files.select("batch_id", "ord", "name", "size_bytes", "modified", fault.alias("__fault"))
        .withColumn("__rank", F.row_number().over(order))
        .filter(F.col("__rank") <= limit)
        .withColumn("__again", F.row_number().over(same) > 1)
        .select(
            "batch_id", "ord",
            F.coalesce("__fault", F.when(F.col("__again"), "duplicate").otherwise("admitted")).alias("outcome"),
        )
    )
    kept = [c for c in files.columns if c != "outcome"]
    rows = files.select(*kept).join(judged, ["batch_id", "ord"], "left")
    return rows.select(*kept, F.coalesce("outcome", F.lit("over-limit")).alias("outcome"))


def recommendations(files: DataFrame) -> DataFrame:
    """One row per file and recommendation.

    ``files``: file_id, kind, width, height, has_alpha, animated.
    """
    kind = F.col("kind")
    image, video, audio = kind == "image", kind == "video", kind == "audio"
    edge = F.greatest("width", "height")
    rules = (
        (image & F.col("has_alpha"), "image-alpha-lossless"),
        (image & F.col("animated"), "image-animation"),
        (image & (edge < 1280), "image-ai-2x"),
        (video & (F.col("height") >= 2160), "video-1080p"),
        (video, "video-compatible"),
        (video, "video-small"),
        (audio, "audio-compatible"),
        (audio, "audio-small"),
    )
    hits = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for rule, name in rules]))
    return files.select("file_id", F.explode(hits).alias("recommendation"))


def recommendation_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("recommendation").agg(F.count(F.lit(1)).alias("files"))
