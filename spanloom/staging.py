"""Intermediate tables in the folder that all machines of a cluster share.

A table written there cuts the lineage: losing an executor loses none of it. The folder is ``spark.checkpoint.dir`` of the session, made a full URI
once by Hadoop's default file system, so that Spark and Python mean the same place. Where that is unset, a local session (tests) gets a temporary folder
and a cluster its warehouse, unless that is a folder of one machine, which is an error.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with scheme and authority, by Hadoop's default file system where it has none."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def shared_root(spark: SparkSession) -> str:
    """URI of the shared folder for intermediate tables."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return qualified(spark, root).rstrip("/")
    if spark.sparkContext.master.split("[")[0] == "local":
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="spanloom-"))
            atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
        return f"file://{_LOCAL[0]}"
    root = qualified(spark, spark.conf.get("spark.sql.warehouse.dir"))
    if root.startswith("file:"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share: the warehouse is a folder of this machine")
    return root.rstrip("/") + "/_spanloom"


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other call gets."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back. ``staged_at`` of the result is its folder, for :func:`release`."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.staged_at = path
    return found


def release(*tables: DataFrame | None) -> None:
    """Delete the folders of tables that :func:`staged` gave and that nothing will read again."""
    for df in tables:
        if df is not None:
            drop(df.sparkSession, df.staged_at)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder of :func:`new_path`."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
