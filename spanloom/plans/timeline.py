"""Timed segments and chunks as ordinary tables.

segments (file_id, seg_idx, start_s, end_s, text) have absolute times, chunk segments times from their chunk's start. Order is that of
(chunk_index, seg_idx), never of times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import text as T

WORDS_PER_SEGMENT, SECONDS_PER_WORD = 8, 0.5
CHUNK_S, OVERLAP_S = 120.0, 30.0


def segments_of(texts: DataFrame, file_id: str, text: str, per_segment: int = WORDS_PER_SEGMENT, pace: float = SECONDS_PER_WORD) -> DataFrame:
    """Segments of ``per_segment`` words at a constant pace; a map-side explode, no shuffle."""
    split = texts.select(F.col(file_id).alias("file_id"), T.words(F.col(text)).alias("w"))
    n = F.size("w")
    rows = split.select("file_id", "w", n.alias("n"), F.explode(F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / per_segment).cast("int")))).alias("k"))
    first = F.col("k") * per_segment
    return rows.select("file_id", F.col("k").cast("long").alias("seg_idx"), (first * pace).alias("start_s"), (F.least(first + per_segment, F.col("n")) * pace).alias("end_s"), F.array_join(F.slice("w", first + 1, per_segment), " ").alias("text"))


def files_of(texts: DataFrame, file_id: str, text: str, pace: float = SECONDS_PER_WORD) -> DataFrame:
    """(file_id, duration_s): whole seconds."""
    return texts.select(F.col(file_id).alias("file_id"), F.floor(F.size(T.words(F.col(text))) * pace).cast("long").alias("duration_s"))


def within_limit(files: DataFrame, max_hours: int = 24) -> DataFrame:
    """``files``; reading one whose whole hours exceed the limit is an error."""
    hours = F.floor(F.col("duration_s") / 3600)
    error = F.raise_error(F.format_string("file %s has %d hours, more than the limit", F.col("file_id").cast("string"), hours))
    return files.withColumn("duration_s", F.when(hours > max_hours, error.cast("long")).otherwise(F.col("duration_s")))


def sliced(segments: DataFrame, chunks: DataFrame, width_s: float = CHUNK_S) -> DataFrame:
    """Chunk rows (file_id, chunk_index, start_time, end_time, seg_idx, start_s, end_s, text): the segments that start inside each chunk, in times from the chunk's start,
    and rows without a segment (seg_idx null) that show a chunk where it has none.

    An interval join as an equi-join on (file, time bin): each chunk is listed under the bins that it touches, each segment has one bin, so a long
    file costs its segments times their overlap and not segments times chunks.
    """
    bins = F.sequence(F.floor(F.col("start_time") / width_s), F.floor(F.col("end_time") / width_s))
    c = chunks.select("file_id", "chunk_index", "start_time", "end_time", F.explode(bins).alias("bin")).alias("c")
    s = segments.withColumn("bin", F.floor(F.col("start_s") / width_s)).alias("s")
    inside = (F.col("s.start_s") >= F.col("c.start_time")) & (F.col("s.start_s") < F.col("c.end_time"))
    joined = c.join(s, (F.col("c.file_id") == F.col("s.file_id")) & (F.col("c.bin") == F.col("s.bin")) & inside, "left")
    rebased = [(F.col(f"s.{x}") - F.col("c.start_time")).alias(x) for x in ("start_s", "end_s")]
    return joined.select("c.file_id", "c.chunk_index", "c.start_time", "c.end_time", "s.seg_idx", *rebased, "s.text")


def chunk_rows(chunk_segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk rows, as of :func:`sliced`, from a table of chunk segments and one of chunks."""
    keys = ["file_id", "chunk_index"]
    return chunks.select(*keys, "start_time", "end_time").join(chunk_segments, keys, "left").select(*keys, "start_time", "end_time", "seg_idx", "start_s", "end_s", "text")


def slice_by_chunks(segments: DataFrame, chunks: DataFrame, width_s: float = CHUNK_S) -> DataFrame:
    """Segments that start inside each chunk, in times from the chunk's start."""
    return sliced(segments, chunks, width_s).where(F.col("seg_idx").isNotNull()).select("file_id", "chunk_index", "seg_idx", "start_s", "end_s", "text")


def renumbered(chunk_segments: DataFrame) -> DataFrame:
    """``seg_idx`` from 0 within each chunk; needs segments without gaps in their numbers."""
    from pyspark.sql import Window

    least = F.min("seg_idx").over(Window.partitionBy("file_id", "chunk_index"))
    return chunk_segments.withColumn("seg_idx", F.col("seg_idx") - least)


def absolute(chunk_start: Column, time: Column) -> Column:
    return chunk_start + time


def perturbed(chunk_segments: DataFrame) -> DataFrame:
    """The same words as another recogniser pass might give them: odd chunks with A to Z in upper case and without commas."""
    odd = F.col("chunk_index") % 2 == 1
    return chunk_segments.withColumn("text", F.when(odd, F.translate("text", "abcdefghijklmnopqrstuvwxyz,", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(F.col("text")))


def aggregated(chunk_segments: DataFrame) -> DataFrame:
    """One row per chunk: first start, last end, number of segments and the text in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "text"))), lambda x: x["text"])
    return chunk_segments.groupBy("file_id", "chunk_index").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.count(F.lit(1)).alias("n_segments"), F.array_join(ordered, " ").alias("text"))


def concatenated(chunk_segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """Merge for chunks without overlap: absolute times in order, with ``overlaps`` where a segment starts before the one before it ends."""
    from pyspark.sql import Window

    rows = chunk_segments.join(chunks.select("file_id", "chunk_index", "start_time"), ["file_id", "chunk_index"])
    rows = rows.select("file_id", "chunk_index", "seg_idx", *[absolute(F.col("start_time"), F.col(x)).alias(x) for x in ("start_s", "end_s")], "text")
    order = Window.partitionBy("file_id").orderBy("chunk_index", "seg_idx")
    return rows.withColumn("overlaps", F.coalesce(F.lag("end_s").over(order) > F.col("start_s"), F.lit(False)))


def first_language(chunks: DataFrame, default: str = "en") -> DataFrame:
    """(file_id, language) of each file's first chunk."""
    return chunks.groupBy("file_id").agg(F.coalesce(F.min_by("language", "chunk_index"), F.lit(default)).alias("language"))
