"""Merging overlapping chunk transcripts into one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators.match import MIN_RUN, common_words, in_both_roles, neighbours, runs_of
from spanloom.plans.timeline import absolute, chunk_rows

KEYS = ["file_id", "chunk_index"]


def words_before(segments: DataFrame) -> DataFrame:
    """``segments`` with ``before``: words of the segments before it in its chunk, blank ones counting 1."""
    order = Window.partitionBy(*KEYS).orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("before", F.coalesce(F.sum(T.count_trimmed(F.col("text"))).over(order), F.lit(0)))


def drop_first_words(segments: DataFrame, n: Column) -> DataFrame:
    """Segments without those that start within the first ``n`` words of their chunk, a straddling one included."""
    return words_before(segments).where(F.col("before") >= n).drop("before")


def decided(rows: DataFrame, least: int = MIN_RUN) -> DataFrame:
    """Every segment of some chunk rows with its chunk's branch, the words to drop and the absolute time to start at.

    first        no chunk before it: all
    prev_empty   the one before has no segments: all
    cur_empty    none
    no_overlap   no segment of the one before starts in the overlap: all
    timestamp    no common run of ``least`` words: what starts at or after the end of the last listed segment before
    match        what comes after the run; what is before the run goes as well

    One shuffle by file; all steps are windows within the file. ``keep_before`` is the smallest end of the chunk and all later ones but the last.
    """
    known = neighbours(rows)
    back = Window.partitionBy("file_id").orderBy(F.col("chunk_index").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    is_last = F.col("next_start").isNull()
    known = known.withColumn("keep_before", F.when(~is_last, F.min(F.when(~is_last, F.col("end_time"))).over(back)))
    known = words_before(known)
    kept = ["seg_idx", "start_s", "end_s", "text", "before", "start_time", "prev_n", "prev_start", "prev_last_start", "prev_last_end", "keep_before"]
    found = runs_of(common_words(in_both_roles(known, kept)), least).where("role = 0 or run is not null")
    rows = found.withColumn("best", F.min("run").over(Window.partitionBy(*KEYS))).where("role = 0").select(*KEYS, "kept.*", "best")
    branch = (
        F.when(F.col("prev_start").isNull(), "first")
        .when(F.col("prev_n") == 0, "prev_empty")
        .when(F.col("prev_last_start") < F.col("start_time") - F.col("prev_start"), "no_overlap")
        .when(F.col("best").isNull(), "timestamp")
        .otherwise("match")
    )
    rows = rows.withColumn("branch", branch)
    drop = F.when(F.col("branch") == "match", F.col("best.s2") - F.col("best.n")).otherwise(F.lit(0))
    start = F.when(F.col("branch") == "timestamp", F.col("prev_start") + F.col("prev_last_end"))
    times = [absolute(F.col("start_time"), F.col(c)).alias(c) for c in ("start_s", "end_s")]
    return rows.select(*KEYS, "seg_idx", *times, "text", "branch", "before", drop.alias("drop_words"), start.alias("start_at"), "keep_before")


def merge_pairs_of(rows: DataFrame, least: int = MIN_RUN) -> DataFrame:
    """What each chunk contributes after the one before it, in absolute times, with the branch that decided; ``keep_before`` is for the fold.

    Every pair depends on its two raw chunks alone, so all pairs of all files run in one plan.
    """
    kept = (F.col("before") >= F.col("drop_words")) & (F.col("start_at").isNull() | (F.col("start_s") >= F.col("start_at")))
    return decided(rows, least).where(kept).select(*KEYS, "seg_idx", "start_s", "end_s", "text", "branch", "keep_before")


def merge_transcripts_of(rows: DataFrame, least: int = MIN_RUN) -> DataFrame:
    """One transcript per file from chunk rows: (file_id, seq, chunk_index, seg_idx, start_s, end_s, text).

    Folding chunk by chunk and cutting the result so far at each chunk's end comes to keeping a segment if it starts before the smallest end of its own and all
    later chunks but the last; that is a window minimum.
    """
    rows = merge_pairs_of(rows, least).where(F.col("keep_before").isNull() | (F.col("start_s") < F.col("keep_before")))
    seq = F.row_number().over(Window.partitionBy("file_id").orderBy("chunk_index", "seg_idx")) - 1
    return rows.select("file_id", seq.cast("long").alias("seq"), "chunk_index", "seg_idx", "start_s", "end_s", "text")


def merge_pairs(chunk_segments: DataFrame, chunks: DataFrame, least: int = MIN_RUN) -> DataFrame:
    """:func:`merge_pairs_of` a table of chunk segments and one of chunks."""
    return merge_pairs_of(chunk_rows(chunk_segments, chunks), least)


def merge_transcripts(chunk_segments: DataFrame, chunks: DataFrame, least: int = MIN_RUN) -> DataFrame:
    """:func:`merge_transcripts_of` a table of chunk segments and one of chunks."""
    return merge_transcripts_of(chunk_rows(chunk_segments, chunks), least)


def decisions(chunk_segments: DataFrame, chunks: DataFrame, least: int = MIN_RUN) -> DataFrame:
    """(file_id, chunk_index, branch) of every chunk, those without segments included."""
    rows = chunk_rows(chunk_segments, chunks)
    empty = neighbours(rows).where("n = 0").select(*KEYS, F.when(F.col("prev_start").isNull(), "first").when(F.col("prev_n") == 0, "prev_empty").otherwise("cur_empty").alias("branch"))
    return decided(rows, least).select(*KEYS, "branch").distinct().unionByName(empty.distinct())


def after_word(segments: DataFrame, n: Column) -> DataFrame:
    """(file_id, chunk_index, at): end of the first segment with which a chunk's words, blank texts counting 1, are ``n`` or more, else of its last one."""
    reached = F.col("before") + T.count_trimmed(F.col("text")) >= n
    first, last = F.min(F.when(reached, F.struct("seg_idx", "end_s"))), F.max(F.struct("seg_idx", "end_s"))
    return words_before(segments).groupBy(*KEYS).agg(F.coalesce(first["end_s"], last["end_s"]).alias("at"))


def starting_after(chunk_segments: DataFrame, chunks: DataFrame, at: DataFrame) -> DataFrame:
    """Segments in absolute times that start at or after a time per chunk (file_id, chunk_index, start_at)."""
    rows = chunk_segments.join(chunks.select(*KEYS, "start_time"), KEYS).join(at, KEYS)
    times = [absolute(F.col("start_time"), F.col(c)).alias(c) for c in ("start_s", "end_s")]
    return rows.where(absolute(F.col("start_time"), F.col("start_s")) >= F.col("start_at")).select(*KEYS, "seg_idx", *times, "text")
