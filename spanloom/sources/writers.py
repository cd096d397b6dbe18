"""Transcripts as JSON and SRT, one document per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.times import timecode, with_extension
from spanloom.shared_fs import open_fs


def srt_lines(merged: DataFrame) -> DataFrame:
    """(file_id, seq, block): numbered from 1, each block ended by an empty line."""
    number = F.row_number().over(Window.partitionBy("file_id").orderBy("seq"))
    block = F.format_string("%d\n%s --> %s\n%s\n\n", number, timecode(F.col("start_s")), timecode(F.col("end_s")), "text")
    return merged.select("file_id", "seq", block.alias("block"))


def srt_documents(merged: DataFrame) -> DataFrame:
    """(file_id, srt), blocks in order."""
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("seq", "block"))), lambda x: x["block"])
    return srt_lines(merged).groupBy("file_id").agg(F.array_join(blocks, "").alias("srt"))


def json_documents(merged: DataFrame, languages: DataFrame) -> DataFrame:
    """(file_id, json): pretty-printed ``language`` and ``segments`` in order; files without segments have an empty list."""
    listed = merged.groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "start_s", "end_s", "text"))), lambda x: F.struct(x["start_s"].alias("start"), x["end_s"].alias("end"), x["text"].alias("text"))).alias("segments"))
    rows = languages.join(listed, "file_id", "left")
    segments = F.coalesce("segments", F.array().cast("array<struct<start:double,end:double,text:string>>"))
    return rows.select("file_id", F.to_json(F.struct("language", segments.alias("segments")), {"pretty": "true"}).alias("json"))


def output_keys(objects: DataFrame, key: str) -> DataFrame:
    """``objects`` with json_key and srt_key, and ``clash`` where a name would overwrite the object itself."""
    json_key, srt_key = with_extension(F.col(key), ".json"), with_extension(F.col(key), ".srt")
    return objects.withColumns({"json_key": json_key, "srt_key": srt_key, "clash": (json_key == F.col(key)) | (srt_key == F.col(key))})


def write_objects(documents: DataFrame, root: str, key: str = "key", body: str = "body") -> DataFrame:
    """Put each row's body, as UTF-8, as one object ``root/key``, over one that is there; (key, path, length) of what was written, in ``root/_written``.

    Rows are objects, a stream of them in each task, and a task that runs again writes the same. A null or empty key is an error; so is a row whose column ``clash``, if
    there is one, is true: its name is that of the object that it was made from.
    """
    clash = F.col("clash") if "clash" in documents.columns else F.lit(False)
    refused = F.raise_error(F.concat(F.lit("would overwrite its own source, or has no name: "), F.coalesce(key, F.lit("null"))))
    named = F.when(clash | F.col(key).isNull() | (F.col(key) == ""), refused.cast("string")).otherwise(F.col(key))

    def put(batches):
        import pyarrow as pa

        for batch in batches:
            paths, lengths = [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                paths.append(f"{root}/{name}")
                fs, at = open_fs(paths[-1])
                fs.create_dir(at.rpartition("/")[0], recursive=True)
                data = (text or "").encode()
                with fs.open_output_stream(at) as out:
                    out.write(data)
                lengths.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string()), pa.array(lengths, pa.int64())], names=["key", "path", "length"])

    schema = "key string, path string, length long"
    documents.select(named.alias("key"), F.col(body).alias("body")).mapInArrow(put, schema).write.mode("overwrite").parquet(f"{root}/_written")
    return documents.sparkSession.read.schema(schema).parquet(f"{root}/_written")


def write_documents(documents: DataFrame, column: str, root: str) -> None:
    """Write one text file set per file_id under ``root``, replacing what is there, files of one id by one task. Refuses rows whose ``clash``, if there is such a column, is true."""
    clash = F.col("clash") if "clash" in documents.columns else F.lit(False)
    value = F.when(clash, F.raise_error(F.lit("would overwrite its own source")).cast("string")).otherwise(F.col(column))
    documents.select("file_id", value.alias("value")).repartition("file_id").write.mode("overwrite").partitionBy("file_id").text(root)
