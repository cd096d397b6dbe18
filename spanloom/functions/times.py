"""Functions on times in seconds, and on storage keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def timecode(seconds: Column) -> Column:
    """``HH:MM:SS,mmm``, milliseconds cut off, hours beyond 24 kept."""
    whole = F.floor(seconds)
    parts = [(seconds / 3600).cast("int"), ((seconds % 3600) / 60).cast("int"), (seconds % 60).cast("int"), ((seconds - whole) * 1000).cast("int")]
    return F.format_string("%02d:%02d:%02d,%03d", *parts)


def near(a: Column, b: Column, tolerance: float = 1.0) -> Column:
    """Strictly closer than ``tolerance``."""
    return F.abs(a - b) < tolerance


def cache_key(bucket: Column, key: Column, position: Column, duration: Column) -> Column:
    return F.format_string("%s:%s:%.2f:%.2f", bucket, key, position, duration)


def chunk_key(bucket: Column, key: Column, index: Column, start: Column, end: Column) -> Column:
    return F.format_string("%s:%s:chunk-%d:%.2f-%.2f", bucket, key, index, start, end)


def file_prefix(bucket: Column, key: Column) -> Column:
    return F.format_string("%s:%s:", bucket, key)


def with_extension(key: Column, extension: str) -> Column:
    """The last dot and what follows replaced; a key without a dot stays as it is."""
    return F.regexp_replace(key, r"\.[^.]+$", extension)


def transcript_name(key: Column, extension: str) -> Column:
    return F.concat(F.regexp_replace(key, r"\.[^.]+$", ""), F.lit("_transcript" + extension))


def estimated_bytes(start: Column, end: Column, rate: int = 16_384, buffer_s: float = 1.0) -> tuple[Column, Column]:
    """(first, last) byte of a time range at a constant rate, widened by a buffer."""
    return F.floor(F.greatest(start - buffer_s, F.lit(0.0)) * rate).cast("long"), F.ceil((end + buffer_s) * rate).cast("long")
