"""Capability queries over a fleet of hosts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..operators import fleet as ops
from ..operators import selection
from ..sources.adapters import sql_over, table, view
from . import register

# Listing lines a host may print, with the capabilities each one stands for.
LISTING = [
    ("formats", " DE matroska,webm   Matroska", (("demuxer", "matroska"), ("demuxer", "webm"), ("muxer", "matroska"), ("muxer", "webm"))),
    ("formats", " D  mov,mp4,m4a     QuickTime", (("demuxer", "mov"), ("demuxer", "mp4"), ("demuxer", "m4a"))),
    ("formats", "  E mp4             MP4", (("muxer", "mp4"),)),
    ("formats", "  E mov             MOV", (("muxer", "mov"),)),
    ("formats", " DE mp3             MP3", (("demuxer", "mp3"), ("muxer", "mp3"))),
    ("formats", "  E adts            ADTS", (("muxer", "adts"),)),
    ("formats", "  E ipod            iPod", (("muxer", "ipod"),)),
    ("formats", " DE ogg             Ogg", (("demuxer", "ogg"), ("muxer", "ogg"))),
    ("formats", " DE flac            FLAC", (("demuxer", "flac"), ("muxer", "flac"))),
    ("formats", " DE wav             WAV", (("demuxer", "wav"), ("muxer", "wav"))),
    ("formats", "File formats:", ()),
    ("encoders", " V..... = Video", ()),
    ("decoders", " VFS..D h264                 H.264", (("decoder", "h264"),)),
    ("decoders", " A....D aac                  AAC", (("decoder", "aac"),)),
    ("filters", " TS. scale            V->V", (("filter", "scale"),)),
    ("filters", " ... libvmaf          VV->V", (("filter", "libvmaf"),)),
    ("filters", " T.. = Timeline support", ()),
    ("hwaccels", "Hardware acceleration methods:", ()),
    ("hwaccels", "cuda", (("hwaccel", "cuda"),)),
    ("hwaccels", "qsv", (("hwaccel", "qsv"),)),
    *[
        ("encoders", f" V....D {name}   some encoder", (("encoder", name),))
        for name in (
            "libx264", "libx265", "libsvtav1", "libaom-av1", "libvpx-vp9",
            *[n for _, n, _ in dims.HARDWARE_PREFERENCE],
        )
    ],
    *[
        ("encoders", f" A....D {name}   some encoder", (("encoder", name),))
        for name in ("aac", "libmp3lame", "libopus", "libvorbis", "flac", "pcm_s16le")
    ],
]


def lines(spark, sf_dir):
    """Listings of all hosts: each supplier prints about two thirds of the lines."""
    rows = [(i, s, t) for i, (s, t, _) in enumerate(LISTING)]
    catalog = dims.struct_array(rows, (("i", "int"), ("section", "string"), ("line", "string")))
    host = F.col("host")
    return (
        table(spark, sf_dir, "supplier")
        .select(F.col("s_suppkey").alias("host"), F.inline(catalog))
        .filter((host * 7 + F.col("i") * F.col("i") + host % 11) % 3 != 0)
    )


def _names() -> str:
    values = ", ".join(
        f"({i}, '{section}', '{name}')" for i, (_, _, caps) in enumerate(LISTING) for section, name in caps
    )
    return f"""
names(i, section, name) AS (VALUES {values}),
caps AS (SELECT DISTINCT s_suppkey AS host, section, name FROM supplier JOIN names ON (s_suppkey * 7 + i * i + s_suppkey % 11) % 3 <> 0)"""


CAPS_SQL = _names().strip()


def capabilities(spark, sf_dir):
    return ops.parse_capabilities(lines(spark, sf_dir))


@register("s11_parse_capabilities", sql_over([], f"WITH {CAPS_SQL} SELECT * FROM caps"))
def parse_capabilities(spark, sf_dir):
    return capabilities(spark, sf_dir)


@register("u1_merged_names", sql_over([], f"WITH {CAPS_SQL} SELECT DISTINCT section, name FROM caps"))
def merged_names(spark, sf_dir):
    caps = capabilities(spark, sf_dir)
    return ops.merged_names(
        caps.filter("host % 2 = 0").select("section", "name"),
        caps.filter("host % 2 = 1").select("section", "name"),
    )


REQUIREMENT_ROWS = ", ".join(
    f"('{c}', '{o}', {n}, '{s}', '{name}')"
    for c, o, groups in dims.OUTPUT_REQUIREMENTS
    for n, (s, names) in enumerate(groups)
    for name in names
)
OUTPUTS_SQL = f"""{CAPS_SQL},
req(category, output, need, section, name) AS (VALUES {REQUIREMENT_ROWS}),
needed AS (SELECT category, output, count(DISTINCT need) AS n FROM req GROUP BY ALL),
met AS (SELECT host, category, output, count(DISTINCT need) AS m FROM caps JOIN req USING (section, name) GROUP BY ALL),
outs AS (SELECT host, category, output FROM met JOIN needed USING (category, output) WHERE m = n)"""


def outputs(spark, sf_dir):
    return ops.supported_outputs(capabilities(spark, sf_dir), dims.output_requirements(spark))


@register("j2_supported_outputs", sql_over([], f"WITH {OUTPUTS_SQL} SELECT * FROM outs"))
def supported_outputs(spark, sf_dir):
    return outputs(spark, sf_dir)


@register(
    "j4_pick_encoder",
    sql_over(
        [],
        f"""WITH {CAPS_SQL}, pref(codec, name, rank) AS (VALUES {', '.join(f"('{c}', '{n}', {r})" for c, n, r in dims.HARDWARE_PREFERENCE)})
SELECT host, codec, arg_min(name, rank) AS encoder FROM caps JOIN pref USING (name) WHERE section = 'encoder' GROUP BY host, codec""",
    ),
)
def pick_encoder(spark, sf_dir):
    preference = dims.frame(spark, dims.HARDWARE_PREFERENCE, "codec string, name string, rank int")
    return ops.pick_encoder(capabilities(spark, sf_dir), preference)


@register(
    "j4_vendors",
    sql_over(
        [],
        f"""WITH {CAPS_SQL} SELECT host, count(DISTINCT regexp_extract(name, '_(nvenc|qsv|amf|videotoolbox|vaapi)$', 1)) AS vendors, count(DISTINCT name) AS encoders
FROM caps WHERE section = 'encoder' AND regexp_matches(name, '_(nvenc|qsv|amf|videotoolbox|vaapi)$') GROUP BY host""",
    ),
)
def vendors(spark, sf_dir):
    return ops.vendors(capabilities(spark, sf_dir))


@register(
    "u4_usable_formats",
    sql_over(
        ["media_files"],
        f"""WITH {OUTPUTS_SQL},
want AS (SELECT DISTINCT batch_id, batch_id % 10 AS host, CASE WHEN kind = 'video' THEN 'webm' WHEN kind = 'audio' THEN 'm4a' ELSE 'mp4' END AS output FROM media_files)
SELECT batch_id, want.host, want.output FROM want WHERE EXISTS (SELECT 1 FROM outs WHERE outs.host = want.host AND outs.output = want.output)""",
    ),
)
def usable_formats(spark, sf_dir):
    kind = F.col("kind")
    wanted = view(spark, sf_dir, "media_files").select(
        "batch_id", (F.col("batch_id") % 10).alias("host"),
        F.when(kind == "video", "webm").when(kind == "audio", "m4a").otherwise("mp4").alias("output"),
    ).distinct()
    return ops.usable_formats(wanted, outputs(spark, sf_dir)).select("batch_id", "host", "output")


@register(
    "u4_common_formats",
    sql_over([], f"WITH {OUTPUTS_SQL} SELECT output FROM outs WHERE host % 2 = 0 INTERSECT SELECT output FROM outs WHERE host % 2 = 1"),
)
def common_formats(spark, sf_dir):
    found = outputs(spark, sf_dir)
    return ops.common_formats(found.filter("host % 2 = 0"), found.filter("host % 2 = 1"))


@register(
    "j3_enumerate_candidates",
    sql_over(
        ["media_files"],
        f"""WITH {CAPS_SQL}, ladder(codec, crf) AS (VALUES {', '.join(f"('{c}', {r})" for c, r in dims.CRF_LADDER)}),
f AS (SELECT file_id, file_id % 10 AS host, file_id % 7 <> 0 AS av1, file_id % 5 <> 0 AS h265, file_id % 9 <> 0 AS h264, file_id % 8 <> 0 AS ffmpeg,
  CASE file_id % 4 WHEN 0 THEN 'slow' WHEN 1 THEN 'slower' ELSE 'medium' END AS preset FROM media_files WHERE kind = 'video'),
x AS (SELECT f.*, codec, crf, codec = 'av1' AND EXISTS (SELECT 1 FROM caps c WHERE c.host = f.host AND c.name = 'libsvtav1' AND section = 'encoder') AS svt FROM f, ladder
  WHERE CASE codec WHEN 'av1' THEN av1 WHEN 'h265' THEN h265 ELSE h264 END),
e AS (SELECT *, CASE WHEN svt THEN 'libsvtav1' WHEN codec = 'av1' THEN 'libaom-av1' WHEN codec = 'h265' THEN 'libx265' ELSE 'libx264' END AS encoder FROM x),
a AS (SELECT *, ffmpeg AND EXISTS (SELECT 1 FROM caps c WHERE c.host = e.host AND c.section = 'encoder' AND c.name = e.encoder) AS available FROM e)
SELECT file_id, codec || '-crf-' || CAST(crf AS VARCHAR) AS candidate_id, CASE codec WHEN 'av1' THEN 'AV1' WHEN 'h265' THEN 'H.265' ELSE 'H.264 高品質' END || ' CRF ' || CAST(crf AS VARCHAR) AS label,
  codec, encoder, crf, preset, available, CASE WHEN NOT available THEN encoder || 'エンコーダーをこのFFmpegで利用できません。' END AS unavailable_reason FROM a""",
    ),
)
def enumerate_candidates(spark, sf_dir):
    key = F.col("file_id")
    videos = view(spark, sf_dir, "media_files").filter("kind = 'video'").select(
        "file_id", (key % 10).alias("host"), (key % 7 != 0).alias("include_av1"), (key % 5 != 0).alias("include_h265"),
        F.when(key % 9 == 0, False).alias("include_h264"), (key % 8 != 0).alias("ffmpeg_available"),
        F.when(key % 4 == 0, "slow").when(key % 4 == 1, "slower").when(key % 4 == 2, "ultrafast;delete").alias("preset"),
    )
    return selection.enumerate_candidates(videos, capabilities(spark, sf_dir))
