"""Chunk planners: a fixed stride in one expression, and two that follow the words and must go file by file."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.plans.timeline import CHUNK_S, OVERLAP_S

MIN_WORDS, MOST_OVERLAP_S = 5, 120.0
CHUNKS = "file_id long, chunk_index long, start_time double, end_time double"


def fixed(files: DataFrame, chunk_s: float = CHUNK_S, overlap_s: float = OVERLAP_S) -> DataFrame:
    """Chunks of ``chunk_s`` every ``chunk_s - overlap_s`` seconds until the end is reached; none for empty files."""
    if not 0 <= overlap_s < chunk_s:
        raise ValueError("the overlap must be shorter than the chunk")
    stride = chunk_s - overlap_s
    count = F.greatest(F.ceil((F.col("duration_s") - overlap_s) / stride), F.lit(1))
    rows = files.where("duration_s > 0").select("file_id", F.col("duration_s").cast("double").alias("total"), F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("chunk_index"))
    start = F.col("chunk_index") * stride
    return rows.select("file_id", "chunk_index", start.alias("start_time"), F.least(start + chunk_s, F.col("total")).alias("end_time"))


def overlap_after(segments: list[tuple[float, float, int]], end: float, least: float) -> float:
    """Seconds to step back from a chunk's end: to the first segment near it if those have ``MIN_WORDS`` words, else twice ``least`` at most
    ``MOST_OVERLAP_S``. ``segments``: (start, end, words) on the clock that ``end`` is compared with."""
    if not segments:
        return least
    close = [s for s in segments if s[0] < end and s[1] > end - least]
    if sum(s[2] for s in close) >= MIN_WORDS:
        return end - close[0][0]
    return max(least, min(2 * least, MOST_OVERLAP_S))


def plan_file(total: float, segments: list[tuple[float, float, int]], chunk_s: float, least: float, clock: str) -> Iterator[tuple[float, float]]:
    """(start, end) of one file's chunks. ``segments`` in absolute times. ``clock``: "compat" compares chunk-relative segment times with the absolute
    end of the chunk, "fixed" with its relative end. No progress is an error."""
    pos = 0.0
    while pos < total:
        dur = min(chunk_s, total - pos)
        yield pos, pos + dur
        if pos + dur >= total:
            return
        inside = [(s - pos, e - pos, n) for s, e, n in segments if pos <= s < pos + dur]
        step = dur - overlap_after(inside, pos + dur if clock == "compat" else dur, least)
        if step <= 0:
            raise ValueError(f"no progress at {pos} s: the overlap takes the whole chunk")
        pos += step


def _by_file(files: DataFrame, segments: DataFrame, columns: list, plan) -> DataFrame:
    """Run ``plan(total, rows)`` on each file; one shuffle by file, sorted, streamed file by file through Arrow."""
    totals = files.select("file_id", F.lit(-1).cast("long").alias("seg_idx"), F.col("duration_s").cast("double").alias("a"), F.lit(0.0).alias("b"), F.lit(0).cast("long").alias("c"))
    rows = totals.unionByName(segments.select("file_id", "seg_idx", *columns))

    def work(batches):
        import pyarrow as pa

        def out(file_id, total, rows):
            for i, (a, b) in enumerate(plan(total, rows) if total else ()):
                yield file_id, i, a, b

        def packed(rows):
            ids, indexes, starts, ends = zip(*rows, strict=True)
            return pa.RecordBatch.from_pydict({"file_id": pa.array(ids, pa.int64()), "chunk_index": pa.array(indexes, pa.int64()), "start_time": pa.array(starts, pa.float64()), "end_time": pa.array(ends, pa.float64())})

        current, total, segs = None, 0.0, []
        for batch in batches:
            done = []
            for file_id, seg_idx, a, b, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if seg_idx == -1:
                    done += out(current, total, segs)
                    current, total, segs = file_id, a, []
                elif file_id == current:
                    segs.append((a, b, c))
            if done:
                yield packed(done)
        if last := list(out(current, total, segs)):
            yield packed(last)

    return rows.repartition("file_id").sortWithinPartitions("file_id", "seg_idx").mapInArrow(work, CHUNKS)


def dynamic(files: DataFrame, segments: DataFrame, chunk_s: float = CHUNK_S, overlap_s: float = OVERLAP_S, clock: str = "compat") -> DataFrame:
    """Chunks whose overlap follows the recognised words, each planned from the chunk before it."""
    from spanloom.functions.text import count_untrimmed

    columns = [F.col("start_s").alias("a"), F.col("end_s").alias("b"), count_untrimmed(F.col("text")).cast("long").alias("c")]
    return _by_file(files, segments, columns, lambda total, rows: plan_file(total, rows, chunk_s, overlap_s, clock))


def silence_cuts(total: float, silences: list[tuple[float, float]], most_s: float, look_s: float, least_s: float) -> Iterator[tuple[float, float]]:
    """Chunks without overlap, cut in the middle of the longest silence of ``least_s`` or more in the last ``look_s`` seconds before ``most_s``."""
    pos = 0.0
    while pos < total:
        end = min(pos + most_s, total)
        if end < total:
            fit = [(b - a, -a, (a + b) / 2) for a, b in silences if b - a >= least_s and a >= max(pos, end - look_s) and b <= end]
            end = max(fit)[2] if fit else end
        yield pos, end
        pos = end


def at_silences(files: DataFrame, segments: DataFrame, most_s: float = 3600.0, look_s: float = 600.0, least_s: float = 1.0) -> DataFrame:
    """:func:`silence_cuts` of every file; silences are the gaps between segments. Documented behaviour without a reference implementation."""
    from pyspark.sql import Window

    nxt = F.lead("start_s").over(Window.partitionBy("file_id").orderBy("seg_idx"))
    gaps = segments.withColumn("next", nxt).where(F.col("next") - F.col("end_s") >= least_s)
    columns = [F.col("end_s").alias("a"), F.col("next").alias("b"), F.lit(0).cast("long").alias("c")]
    return _by_file(files, gaps, columns, lambda total, rows: silence_cuts(total, [r[:2] for r in rows], most_s, look_s, least_s))


def count_fixed(total: float, chunk_s: float, overlap_s: float) -> int:
    """Number of :func:`fixed` chunks of one file."""
    return 0 if total <= 0 else max(1, math.ceil((total - overlap_s) / (chunk_s - overlap_s)))
