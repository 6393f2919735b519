"""Download names."""

from __future__ import annotations

import sys
import unicodedata

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .staging import settle

# Python workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# --- fixed values: characters and names not allowed in download names ------------
INVALID_CHARACTERS = "".join(map(chr, range(0x20))) + '\x7f<>:"/\\|?*'
TRAILING = ". "
RESERVED = r"(?i)^(?:con|prn|aux|nul|com[1-9]|lpt[1-9])(?:\..*)?$"
FALLBACK = "compressed_file"


@F.pandas_udf(StringType())
def _compose(names: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no such function."""
    return names.map(lambda n: None if n is None else unicodedata.normalize("NFC", n))


def normalize_names(df: DataFrame, column: str) -> DataFrame:
    """NFC form of a name column, in one pass. Only non-ASCII names leave the JVM as text."""
    # more bytes than characters
    foreign = F.octet_length(column) != F.length(column)
    composed = _compose(F.when(foreign, F.col(column)))
    return df.withColumn(column, F.coalesce(composed, F.col(column)))


def clean(name: Column) -> Column:
    """Replace invalid characters, strip trailing dots and spaces."""
    replaced = F.translate(
        F.coalesce(name, F.lit("")), INVALID_CHARACTERS, "_" * len(INVALID_CHARACTERS)
    )
    return F.rtrim(replaced, F.lit(TRAILING))


def guard(name: Column, fallback: str = FALLBACK) -> Column:
    """Stand-in for an empty name, underscore before a reserved device name."""
    return (
        F.when(name == "", F.lit(fallback))
        .when(name.rlike(RESERVED), F.concat(F.lit("_"), name))
        .otherwise(name)
    )


def sanitize(name: Column, fallback: str = FALLBACK) -> Column:
    return guard(clean(name), fallback)


def extension(ext: Column) -> Column:
    """Lower-case letters and digits of an extension; ``bin`` when nothing is left."""
    bare = F.lower(F.regexp_replace(F.trim(F.coalesce(ext, F.lit(""))), r"^\.+", ""))
    kept = F.regexp_replace(bare, "[^a-z0-9]", "")
    return F.when(kept == "", "bin").otherwise(kept)


def without_extension(name: Column) -> Column:
    tail = F.length(F.substring_index(name, ".", -1)) + 1
    return F.when(
        F.instr(name, ".") > 0, F.substring(name, F.lit(1), F.length(name) - tail)
    ).otherwise(name)


def compressed_name(original: Column, ext: Column) -> Column:
    """``photo.jpg`` to ``photo_comp.webp``."""
    base = sanitize(without_extension(sanitize(original, "")))
    return F.concat(base, F.lit("_comp."), extension(ext))


def with_compressed_stem(df: DataFrame, original: str, stem: str) -> DataFrame:
    """``compressed_name`` without its extension as a column, for whole tables.

    Each step reads the one before several times, so each is settled.
    """
    rows = settle(df, {"__clean": clean(F.col(original))})
    rows = settle(rows, {"__safe": guard(F.col("__clean"), "")})
    rows = settle(rows, {"__base": clean(without_extension(F.col("__safe")))})
    return rows.withColumn(stem, F.concat(guard(F.col("__base")), F.lit("_comp"))).drop(
        "__clean", "__safe", "__base"
    )


def attachment_header(name: Column) -> Column:
    """Header-safe attachment name: ASCII fallback and percent-encoded form."""
    safe = sanitize(name)
    ascii_name = F.regexp_replace(F.regexp_replace(safe, r"[^\x20-\x7e]", "_"), r'["\\]', "_")
    # url_encode writes a space as '+' and leaves '*'; a literal '+' arrives as %2B.
    encoded = F.replace(
        F.replace(F.url_encode(safe), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")
    )
    encoded = F.replace(encoded, F.lit("%7E"), F.lit("~"))
    return F.concat(
        F.lit('attachment; filename="'), ascii_name, F.lit("\"; filename*=UTF-8''"), encoded
    )
