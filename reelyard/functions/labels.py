"""Human-readable labels for report columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import fixed, half_up

_UNITS = (("KB", 1024, 1), ("MB", 1024**2, 2), ("GB", 1024**3, 2))


def byte_label(size: Column) -> Column:
    """``512 B``, ``1.5 KB``, ``2.25 MB``, ``3.00 GB``; the sign is kept."""
    amount = F.abs(size.cast("double"))
    sign = F.when(size < 0, F.lit("-")).otherwise(F.lit(""))
    parts = [
        F.format_string(f"%.{digits}f {unit}", fixed(amount / F.lit(float(base)), digits))
        for unit, base, digits in _UNITS
    ]
    text = (
        F.when(amount < 1024, F.format_string("%d B", half_up(amount)))
        .when(amount < 1024**2, parts[0])
        .when(amount < 1024**3, parts[1])
        .otherwise(parts[2])
    )
    return F.when(size.isNotNull(), F.concat(sign, text))


def bitrate_label(bits_per_second: Column) -> Column:
    rate = bits_per_second.cast("double")
    return (
        F.when(rate.isNull() | (rate == 0), F.lit("unknown"))
        .when(rate >= 1_000_000, F.format_string("%.2f Mbps", fixed(rate / 1e6, 2)))
        .otherwise(F.format_string("%d kbps", half_up(rate / 1000)))
    )


def elapsed_label(seconds: Column) -> Column:
    """``1h 2m 3s``, ``2m 3s`` or ``3s``."""
    safe = F.greatest(F.lit(0).cast("bigint"), half_up(seconds))
    hours, minutes, rest = F.floor(safe / 3600), F.floor(safe % 3600 / 60), safe % 60
    return (
        F.when(seconds.isNull(), F.lit("--"))
        .when(hours > 0, F.format_string("%dh %dm %ds", hours, minutes, rest))
        .when(minutes > 0, F.format_string("%dm %ds", minutes, rest))
        .otherwise(F.format_string("%ds", rest))
    )


def media_time_label(seconds: Column) -> Column:
    """``h:mm:ss`` or ``m:ss``."""
    safe = F.greatest(F.lit(0).cast("bigint"), F.floor(seconds))
    hours, minutes, rest = F.floor(safe / 3600), F.floor(safe % 3600 / 60), safe % 60
    return (
        F.when(seconds.isNull(), F.lit("--:--"))
        .when(hours > 0, F.format_string("%d:%02d:%02d", hours, minutes, rest))
        .otherwise(F.format_string("%d:%02d", minutes, rest))
    )
