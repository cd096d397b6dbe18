"""A transcription request: its defaults and limits, for one request and for a table of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import jtrim

#: Defaults, and least and most seconds.
CHUNK_SECONDS, MIN_OVERLAP_SECONDS, SAVE = 3600, 30, True
CHUNK_LIMITS, OVERLAP_LIMITS = (10, 3600), (30, 120)


@dataclass(frozen=True)
class Request:
    """Where the audio is and how to cut it. None stands for the default; a blank place or a number beyond its limits is an error."""

    bucket: str
    key: str
    chunk_seconds: int | None = None
    min_overlap_seconds: int | None = None
    save: bool | None = None

    def __post_init__(self):
        for name, default in (("chunk_seconds", CHUNK_SECONDS), ("min_overlap_seconds", MIN_OVERLAP_SECONDS), ("save", SAVE)):
            if getattr(self, name) is None:
                object.__setattr__(self, name, default)
        wrong = [n for n in ("bucket", "key") if not (getattr(self, n) or "").strip("".join(map(chr, range(33))))]
        for name, (least, most) in (("chunk_seconds", CHUNK_LIMITS), ("min_overlap_seconds", OVERLAP_LIMITS)):
            if not least <= getattr(self, name) <= most:
                wrong.append(name)
        if wrong:
            raise ValueError("not allowed: " + ", ".join(wrong))


def checked(requests: DataFrame) -> DataFrame:
    """``requests`` (bucket, key, chunk_seconds, min_overlap_seconds, save) with defaults for nulls and ``wrong``: the names of what is not allowed, in that order."""
    filled = requests.withColumns({
        "chunk_seconds": F.coalesce("chunk_seconds", F.lit(CHUNK_SECONDS)), "min_overlap_seconds": F.coalesce("min_overlap_seconds", F.lit(MIN_OVERLAP_SECONDS)), "save": F.coalesce("save", F.lit(SAVE)),
    })
    blank = {n: F.coalesce(jtrim(F.col(n)), F.lit("")) == "" for n in ("bucket", "key")}
    beyond = {n: ~F.col(n).between(*limits) for n, limits in (("chunk_seconds", CHUNK_LIMITS), ("min_overlap_seconds", OVERLAP_LIMITS))}
    return filled.withColumn("wrong", F.array_compact(F.array(*[F.when(bad, F.lit(n)) for n, bad in (blank | beyond).items()])))
