"""Parsing of loosely typed tool output. Bad input gives null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import fixed

JOB_ID_PATTERN = "^[0-9a-fA-F-]{36}$"


def number(text: Column) -> Column:
    """Finite double, or null."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def positive(text: Column) -> Column:
    """Finite double above zero, or null."""
    value = number(text)
    return F.when(value > 0, value)


def frame_rate(text: Column) -> Column:
    """``30000/1001`` or ``25`` to frames per second with three decimals."""
    pieces = F.split(text, "/")
    top = number(F.get(pieces, F.lit(0)))
    bottom = F.when(F.size(pieces) > 1, number(F.get(pieces, F.lit(1)))).otherwise(F.lit(1.0))
    rate = F.when(bottom > 0, F.try_divide(top, bottom))
    return F.when((text != "0/0") & (rate > 0), fixed(rate, 3))


def clock_seconds(text: Column) -> Column:
    """``hh:mm:ss.f`` to seconds."""
    pattern = r"^(\d+):(\d{2}):(\d{2}(?:\.\d+)?)$"
    clean = F.trim(text)
    hours, minutes, seconds = (
        F.regexp_extract(clean, pattern, i).try_cast("double") for i in (1, 2, 3)
    )
    valid = clean.rlike(pattern) & (minutes < 60) & (seconds < 60)
    return F.when(valid, hours * 3600 + minutes * 60 + seconds)


def with_suffix(text: Column, suffix: str) -> Column:
    """Number in front of a fixed unit such as ``kbits/s`` or ``x``."""
    clean = F.trim(text)
    head = F.trim(
        F.substring(clean, F.lit(1), F.length(clean) - F.lit(len(suffix)))
    )
    return F.when(F.endswith(clean, F.lit(suffix)), number(head))


def valid_job_id(job_id: Column) -> Column:
    return job_id.rlike(JOB_ID_PATTERN)


def trailing_sequence(event_id: Column) -> Column:
    """Number after the last colon of an event id; 0 when there is none."""
    digits = F.regexp_extract(F.trim(event_id), r"(?:^|:)(\d+)$", 1)
    value = digits.try_cast("bigint")
    safe = F.when((value >= 0) & (value <= F.lit(2**53 - 1)), value)
    return F.coalesce(safe, F.lit(0).cast("bigint"))
