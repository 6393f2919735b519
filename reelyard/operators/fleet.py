"""Capabilities of a fleet of hosts: listings, supported outputs, encoder choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims

# --- fixed values: lines of tool listings -----------------------------------------
FORMAT_LINE = r"^\s([D ])([E ])\s+([^\s]+)"
CODEC_LINE = r"(?i)^\s*[VAS][A-Z.]{5}\s+([^\s]+)"
FILTER_LINE = r"^\s*[T.][S.][C.]\s+([^\s]+)"
HWACCEL_LINE = "(?i)^[a-z0-9_]+$"


def parse_capabilities(lines: DataFrame) -> DataFrame:
    """Tool listings ``host, section, line`` to distinct ``host, section, name``.

    Sections: formats (gives demuxer and muxer), decoders, encoders, filters, hwaccels.
    """
    section, line = F.col("section"), F.col("line")
    names = F.split(F.regexp_extract(line, FORMAT_LINE, 3), ",")
    codec = F.regexp_extract(line, CODEC_LINE, 1)
    flt = F.regexp_extract(line, FILTER_LINE, 1)
    accel = F.trim(line)
    is_format = (section == "formats") & line.rlike(FORMAT_LINE)

    def pair(kind: str, values: Column) -> Column:
        return F.struct(F.lit(kind).alias("section"), values.alias("names"))

    none = F.array().cast("array<string>")
    found = F.array(
        pair("demuxer", F.when(is_format & (F.regexp_extract(line, FORMAT_LINE, 1) == "D"), names).otherwise(none)),
        pair("muxer", F.when(is_format & (F.regexp_extract(line, FORMAT_LINE, 2) == "E"), names).otherwise(none)),
        pair("decoder", F.when((section == "decoders") & ~codec.isin("", "="), F.array(codec)).otherwise(none)),
        pair("encoder", F.when((section == "encoders") & ~codec.isin("", "="), F.array(codec)).otherwise(none)),
        pair("filter", F.when((section == "filters") & ~flt.isin("", "="), F.array(flt)).otherwise(none)),
        pair(
            "hwaccel",
            F.when((section == "hwaccels") & accel.rlike(HWACCEL_LINE) & (accel != "Hardware"), F.array(accel)).otherwise(none),
        ),
    )
    rows = lines.select("host", F.inline(found))
    return rows.select("host", "section", F.explode("names").alias("name")).distinct()


def merged_names(*listings: DataFrame) -> DataFrame:
    """Union of capability listings, distinct and sorted."""
    merged = listings[0]
    for more in listings[1:]:
        merged = merged.union(more)
    return merged.distinct().orderBy(*listings[0].columns)


def supported_outputs(capabilities: DataFrame, requirements: DataFrame) -> DataFrame:
    """Outputs each host supports: every required group met by any of its names.

    Relational division: join the capabilities to the requirement names, count the groups
    met, compare with the groups needed. The requirement catalog is fixed and small.
    """
    needed = requirements.groupBy("category", "output").agg(
        F.count_distinct("need").alias("needed")
    )
    met = (
        capabilities.join(requirements, ["section", "name"])
        .groupBy("host", "category", "output")
        .agg(F.count_distinct("need").alias("met"))
    )
    return (
        met.join(needed, ["category", "output"])
        .filter(F.col("met") == F.col("needed"))
        .select("host", "category", "output")
    )


def pick_encoder(capabilities: DataFrame, preference: DataFrame) -> DataFrame:
    """Most preferred hardware encoder of each host and codec.

    ``preference``: codec, name, rank (fixed catalog).
    """
    usable = capabilities.filter(F.col("section") == "encoder").join(preference, "name")
    return usable.groupBy("host", "codec").agg(F.min_by("name", "rank").alias("encoder"))


def vendors(capabilities: DataFrame) -> DataFrame:
    """Number of hardware vendors usable on each host."""
    names = [n for _, n, _ in dims.HARDWARE_PREFERENCE]
    vendor = None
    for suffix, value in dims.VENDOR_SUFFIX:
        hit = F.endswith(F.col("name"), F.lit(suffix))
        vendor = F.when(hit, value) if vendor is None else vendor.when(hit, value)
    hardware = capabilities.filter((F.col("section") == "encoder") & F.col("name").isin(*names))
    return hardware.withColumn("vendor", vendor).groupBy("host").agg(
        F.count_distinct("vendor").alias("vendors"), F.count_distinct("name").alias("encoders")
    )


def usable_formats(batch_formats: DataFrame, outputs: DataFrame) -> DataFrame:
    """Formats a batch asks for that its host can write: ``batch_id, host, output``."""
    return batch_formats.join(outputs.select("host", "output").distinct(), ["host", "output"], "left_semi")


def common_formats(left: DataFrame, right: DataFrame) -> DataFrame:
    """Formats present in both listings."""
    return left.select("output").intersect(right.select("output"))
