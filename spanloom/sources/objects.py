"""Objects of a store as rows, and recogniser output as segments."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.shared_fs import open_fs

RESPONSE = "struct<segments:array<struct<start:double,end:double,text:string>>,language:string>"
TRANSCRIPT = "file_id long, chunk_index long, seg_idx long, start_s double, end_s double, text string"


def heads(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of objects, without reading them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def contents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def ranges(wanted: DataFrame) -> DataFrame:
    """(path, first, content) of byte ranges (path, first, last), both ends included, from 0: only those bytes are read. A range that starts behind the end is empty."""

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            found = []
            for path, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, at = open_fs(path)
                with fs.open_input_file(at) as f:
                    found.append(f.read_at(max(0, min(last + 1, f.size()) - first), min(first, f.size())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["path", "first", "content"])

    plain = wanted.select("path", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))
    return plain.mapInArrow(work, "path string, first long, content binary")


def byte_range(content: Column, first: int, last: int) -> Column:
    """Bytes ``first`` to ``last``, both included, from 0."""
    return F.substring(content, first + 1, last - first + 1)


def responses(chunk_segments: DataFrame, languages: DataFrame | None = None) -> DataFrame:
    """Chunk segments as recogniser responses (file_id, chunk_index, body): what :func:`parsed` reads. ``languages``: (file_id, language)."""
    segment = F.struct("seg_idx", F.struct(F.col("start_s").alias("start"), F.col("end_s").alias("end"), "text").alias("s"))
    listed = chunk_segments.groupBy("file_id", "chunk_index").agg(F.transform(F.array_sort(F.collect_list(segment)), lambda x: x["s"]).alias("segments"))
    rows = listed.join(languages, "file_id", "left") if languages is not None else listed.withColumn("language", F.lit("en"))
    return rows.select("file_id", "chunk_index", F.to_json(F.struct("segments", "language")).alias("body"))


def parsed(bodies: DataFrame, column: str = "body") -> DataFrame:
    """Recogniser responses (file_id, chunk_index, JSON body) as segments."""
    rows = bodies.select("file_id", "chunk_index", F.from_json(column, RESPONSE).alias("r"))
    rows = rows.select("file_id", "chunk_index", F.posexplode("r.segments").alias("i", "s"))
    return rows.select("file_id", "chunk_index", F.col("i").cast("long").alias("seg_idx"), F.col("s.start").alias("start_s"), F.col("s.end").alias("end_s"), F.col("s.text").alias("text"))


class Transcriber(Protocol):
    """A recogniser: segments (start, end, text) of a time range of a file, in times from the range's start."""

    def transcribe(self, file_id: int, chunk_index: int, start: float, end: float) -> list[tuple[float, float, str]]: ...


def transcribe(chunks: DataFrame, transcriber: Transcriber, attempts: int = 3, pause_s: float = 1.0) -> DataFrame:
    """Segments of chunks from a pluggable recogniser, in Arrow batches. OSErrors are tried again after growing random pauses, ``attempts`` times in all."""

    def work(batches):
        import random
        import time

        import pyarrow as pa

        for batch in batches:
            rows = []
            for file_id, index, start, end in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                for attempt in range(1, attempts + 1):
                    try:
                        found = transcriber.transcribe(file_id, index, start, end)
                        break
                    except OSError:
                        if attempt == attempts:
                            raise
                        time.sleep(pause_s * (2**attempt + random.random()))
                rows += [(file_id, index, i, float(s), float(e), t) for i, (s, e, t) in enumerate(found)]
            names = ["file_id", "chunk_index", "seg_idx", "start_s", "end_s", "text"]
            types = [pa.int64()] * 3 + [pa.float64()] * 2 + [pa.string()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return chunks.select("file_id", "chunk_index", "start_time", "end_time").mapInArrow(work, TRANSCRIPT)
