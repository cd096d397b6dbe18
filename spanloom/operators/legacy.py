"""The older merge: each segment against the last ones kept. A fold, so it streams file by file."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import raw_words
from spanloom.plans.timeline import absolute

LOOK_BACK, SIMILAR, TOLERANCE_S = 10, 0.7, 1.0


def word_overlap(a: list[str], b: list[str]) -> float:
    """Occurrences of a's words that b has, over the words of both less those."""
    known = set(b)
    common = sum(w in known for w in a)
    union = len(a) + len(b) - common
    return common / union if union > 0 else 0.0


class Kept:
    """State of one file's fold: the latest end and the last kept segments (start, end, words)."""

    def __init__(self):
        self.last_end, self.recent = 0.0, deque(maxlen=LOOK_BACK)

    def take(self, start: float, end: float, words: list[str]) -> bool:
        """The similarity is that of the kept segment to the new one; it isn't symmetric."""
        if start < self.last_end and any(abs(s - start) < TOLERANCE_S and abs(e - end) < TOLERANCE_S and word_overlap(w, words) >= SIMILAR for s, e, w in self.recent):
            return False
        self.recent.append((start, end, words))
        self.last_end = max(self.last_end, end)
        return True


def judged(chunk_segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """Segments in absolute times with ``kept``: false if one repeats one of the last ``LOOK_BACK`` kept before the latest end."""
    rows = chunk_segments.join(chunks.select("file_id", "chunk_index", "start_time"), ["file_id", "chunk_index"])
    times = [absolute(F.col("start_time"), F.col(c)).alias(c) for c in ("start_s", "end_s")]
    rows = rows.select("file_id", "chunk_index", "seg_idx", *times, "text", raw_words(F.lower("text")).alias("w"))

    def work(batches):
        import pyarrow as pa

        current, state = None, Kept()
        for batch in batches:
            kept = []
            for file_id, start, end, words in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 6)), strict=True):
                if file_id != current:
                    current, state = file_id, Kept()
                kept.append(state.take(start, end, words))
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(kept)], names=[*batch.schema.names[:6], "kept"])

    schema = "file_id long, chunk_index long, seg_idx long, start_s double, end_s double, text string, kept boolean"
    return rows.repartition("file_id").sortWithinPartitions("file_id", "chunk_index", "seg_idx").mapInArrow(work, schema)


def dedup_merge(chunk_segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """Segments in absolute times without the repeats of :func:`judged`."""
    return judged(chunk_segments, chunks).where("kept").drop("kept")


def removed(chunk_segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """(file_id, chunk_index, duplicates_removed, chars_removed) of every chunk with segments; characters are UTF-16 units."""
    units = (F.octet_length(F.encode("text", "UTF-16BE")) / 2).cast("long")
    gone = ~F.col("kept")
    return judged(chunk_segments, chunks).groupBy("file_id", "chunk_index").agg(F.count_if(gone).alias("duplicates_removed"), F.coalesce(F.sum(F.when(gone, units)), F.lit(0)).alias("chars_removed"))
