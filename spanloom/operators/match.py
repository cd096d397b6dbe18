"""Longest common word runs between neighbouring chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.plans.timeline import chunk_rows

MIN_RUN = 3


def overlap_region(chunk_segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """Segments of each chunk's predecessor that start at or after this chunk's start, under this chunk's index.

    Pairs come from an equi-join on (file, index - 1): all pairs of all files at once.
    """
    starts = chunks.select("file_id", "chunk_index", "start_time")
    pairs = starts.alias("c").join(starts.alias("p"), (F.col("c.file_id") == F.col("p.file_id")) & (F.col("c.chunk_index") == F.col("p.chunk_index") + 1))
    pairs = pairs.select("c.file_id", "c.chunk_index", F.col("p.chunk_index").alias("prev_index"), (F.col("c.start_time") - F.col("p.start_time")).alias("offset"))
    prev = chunk_segments.withColumnRenamed("chunk_index", "prev_index")
    return pairs.join(prev, ["file_id", "prev_index"]).where(F.col("start_s") >= F.col("offset")).select("file_id", "chunk_index", "seg_idx", "start_s", "end_s", "text")


def word_rows(segments: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, p, word, norm): words of each key's segments in order, numbered from 0.

    Positions come from a running sum over segments, not words; only then are the words exploded.
    """
    counted = segments.withColumn("w", T.words(F.col("text")))
    order = Window.partitionBy(*keys).orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, -1)
    based = counted.withColumn("base", F.coalesce(F.sum(F.size("w")).over(order), F.lit(0)))
    words = based.select(*keys, "base", F.posexplode("w").alias("i", "word"))
    return words.select(*keys, (F.col("base") + F.col("i")).alias("p"), "word", T.normalize(F.col("word")).alias("norm"))


def longest_runs(words1: DataFrame, words2: DataFrame, keys: list[str], least: int = MIN_RUN) -> DataFrame:
    """(keys, match_length, text1_end, text2_start) of the longest common run of each pair with one of ``least`` words.

    Equal words meet in a hash join with the pair in the key; neighbours on a diagonal form islands; the longest wins, then the first in text 1,
    then the first in text 2. Text 1 is only the overlap, which bounds what frequent words contribute.
    """
    met = words1.select(*keys, F.col("p").alias("p1"), "norm").join(words2.select(*keys, F.col("p").alias("p2"), "norm"), [*keys, "norm"])
    diagonal = (F.col("p2") - F.col("p1")).alias("diagonal")
    met = met.select(*keys, "p1", diagonal)
    island = F.col("p1") - F.row_number().over(Window.partitionBy(*keys, "diagonal").orderBy("p1"))
    runs = met.withColumn("island", island).groupBy(*keys, "diagonal", "island").agg(F.min("p1").alias("s1"), F.count(F.lit(1)).alias("n"))
    best = runs.where(F.col("n") >= least).groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), "s1", (F.col("s1") + F.col("diagonal")).alias("s2"))).alias("b"))
    return best.select(*keys, (-F.col("b.n")).alias("match_length"), (F.col("b.s1") - F.col("b.n")).cast("long").alias("text1_end"), F.col("b.s2").cast("long").alias("text2_start"))


def neighbours(rows: DataFrame) -> DataFrame:
    """Chunk rows with what a chunk needs to know of the ones beside it, by windows over each file; chunk indexes must be consecutive.

    n, prev_n: segments of the chunk and the one before; prev_start, next_start: their start times; prev_last_start: the latest start of a
    segment before; prev_last_end: the end of the last listed segment before.
    """
    order = Window.partitionBy("file_id").orderBy("chunk_index")
    here, before, after = order.rangeBetween(0, 0), order.rangeBetween(-1, -1), order.rangeBetween(1, 1)
    return rows.withColumns({
        "n": F.count("seg_idx").over(here), "prev_n": F.count("seg_idx").over(before), "prev_start": F.max("start_time").over(before), "next_start": F.max("start_time").over(after),
        "prev_last_start": F.max("start_s").over(before), "prev_last_end": F.max(F.struct("seg_idx", "end_s")).over(before)["end_s"],
    })


def in_both_roles(rows: DataFrame, kept: list[str]) -> DataFrame:
    """From the rows of :func:`neighbours`, (file_id, chunk_index, role, seg_idx, kept, w): a segment's words as text 2 of its own chunk (role 2), and, if it starts in the
    overlap, as text 1 of the next (role 1). With ``kept`` columns there is also a row with those and without words for the segment itself (role 0)."""
    whole = rows.where(F.col("seg_idx").isNotNull())
    here, nxt = F.col("chunk_index"), F.col("chunk_index") + 1

    def role(number: int, at, on):
        return F.when(on, F.struct(F.lit(number).alias("role"), at.alias("at")))

    own = [role(0, here, F.lit(True))] if kept else []
    roles = F.array_compact(F.array(*own, role(1, nxt, F.col("start_s") >= F.col("next_start") - F.col("start_time")), role(2, here, F.col("prev_n") > 0)))
    told = F.struct(*kept).alias("kept") if kept else F.lit(None).cast("int").alias("kept")
    spread = whole.select("file_id", "seg_idx", told, "text", F.explode(roles).alias("r"))
    return spread.select("file_id", F.col("r.at").alias("chunk_index"), F.col("r.role").alias("role"), "seg_idx", F.when(F.col("r.role") == 0, F.col("kept")).alias("kept"), F.when(F.col("r.role") > 0, T.words(F.col("text"))).alias("w"))


def within(*columns) -> list:
    """Window keys: a hash of the columns, then the columns. Sorting compares mostly the one number; rows stay with their file."""
    return [F.xxhash64(*columns), *columns]


def common_words(spoken: DataFrame) -> DataFrame:
    """(file_id, chunk_index, role, kept, p1, word, diagonal) of each word of text 1 at each of its likes in text 2, and of the rows of role 0.

    Equal words of a chunk pair meet in a window that gives each word of text 1 the places of its likes in text 2. Everything is a window within the file, so a
    table that is partitioned by file stays where it is.
    """
    pair = ["file_id", "chunk_index"]
    order = Window.partitionBy(*within(*pair, "role")).orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum(F.greatest(F.size("w"), F.lit(0))).over(order), F.lit(0))
    words = spoken.withColumn("base", base).select(*pair, "role", "kept", "base", F.posexplode_outer("w").alias("i", "word"))
    words = words.select(*pair, "role", "kept", (F.col("base") + F.col("i")).alias("p1"), "word", T.normalize(F.col("word")).alias("norm"))
    likes = F.collect_list(F.when(F.col("role") == 2, F.col("p1"))).over(Window.partitionBy(*within(*pair, "norm")))
    met = words.withColumn("likes", likes).where("role = 0 or role = 1 and size(likes) > 0")
    met = met.select(*pair, "role", "kept", "p1", "word", F.explode_outer(F.when(F.col("role") == 1, F.col("likes"))).alias("p2"))
    return met.withColumn("diagonal", F.col("p2") - F.col("p1")).drop("p2")


def runs_of(met: DataFrame, least: int) -> DataFrame:
    """The rows of :func:`common_words` with ``run``, at the last word of each common run of ``least`` words or more: struct(n, s1, s2), n its length made negative, s1 and s2 its
    starts. The least run is the longest, then the first in text 1, then the first in text 2. Neighbours on a diagonal are one run."""
    line = Window.partitionBy(*within("file_id", "chunk_index", "role", "diagonal")).orderBy("p1")
    begins = F.lag("p1").over(line).isNull() | (F.lag("p1").over(line) < F.col("p1") - 1)
    ends = F.lead("p1").over(line).isNull() | (F.lead("p1").over(line) > F.col("p1") + 1)
    marked = met.withColumns({"s1": F.when(begins, F.col("p1")), "ends": ends})
    s1 = F.max("s1").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = marked.withColumn("s1", s1)
    n = F.col("p1") - F.col("s1") + 1
    run = F.struct((-n).alias("n"), "s1", (F.col("s1") + F.col("diagonal")).alias("s2"))
    return found.withColumn("run", F.when((F.col("role") == 1) & F.col("ends") & (n >= least), run)).drop("s1", "ends")


def longest_match_of(rows: DataFrame, least: int = MIN_RUN) -> DataFrame:
    """(file_id, chunk_index, match_length, text1_end, text2_start, matched) from chunk rows; ``matched``: the run's words as text 1 has them."""
    keys = ["file_id", "chunk_index"]
    found = runs_of(common_words(in_both_roles(neighbours(rows), [])), least)
    best = found.withColumn("best", F.min("run").over(Window.partitionBy(*keys)))
    s1, n = F.col("best.s1"), -F.col("best.n")
    inside = best.where((F.col("diagonal") == F.col("best.s2") - s1) & (F.col("p1") >= s1) & (F.col("p1") < s1 + n))
    listed = inside.groupBy(*keys).agg(F.min("best").alias("best"), F.array_sort(F.collect_list(F.struct("p1", "word"))).alias("words"))
    return listed.select(*keys, n.alias("match_length"), (s1 + n).cast("long").alias("text1_end"), F.col("best.s2").cast("long").alias("text2_start"), F.transform("words", lambda x: x["word"]).alias("matched"))


def longest_match(chunk_segments: DataFrame, chunks: DataFrame, least: int = MIN_RUN) -> DataFrame:
    """:func:`longest_match_of` between each chunk's overlap region and its whole text."""
    return longest_match_of(chunk_rows(chunk_segments, chunks), least)


def matched_words(matches: DataFrame, words1: DataFrame, keys: list[str]) -> DataFrame:
    """``matches`` with ``matched``: the run's words as text 1 has them."""
    inside = (F.col("p") >= F.col("text1_end") - F.col("match_length")) & (F.col("p") < F.col("text1_end"))
    rows = words1.join(matches, keys).where(inside).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "word"))), lambda x: x["word"]).alias("matched"))
    return matches.join(rows, keys)
