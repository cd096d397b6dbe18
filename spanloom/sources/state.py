"""The chunk cache and the jobs' log: tables of versions, the latest of which count while they are fresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CACHE_TTL_S, JOB_TTL_S, MOST = 24 * 3600, 60 * 60, 1000
STATUSES = ("PENDING", "PROCESSING", "COMPLETED", "FAILED")


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("rank__", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("rank__ = 1").drop("rank__")


def fresh(rows: DataFrame, at: str, now: Column, ttl_s: int) -> DataFrame:
    """Rows written after ``now`` less the time to live."""
    return rows.where(F.col(at) > now - F.make_dt_interval(secs=F.lit(ttl_s).cast("decimal(18,6)")))


def live(rows: DataFrame, key: str, at: str, now: Column, ttl_s: int) -> DataFrame:
    """The latest row of each key, if it is fresh."""
    return fresh(latest(rows, key, [F.col(at).desc()]), at, now, ttl_s)


def hits(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    return wanted.join(cache.select("cache_key"), "cache_key", "left_semi")


def misses(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    return wanted.join(cache.select("cache_key"), "cache_key", "left_anti")


def without_key(cache: DataFrame, keys: DataFrame) -> DataFrame:
    return cache.join(keys.select("cache_key"), "cache_key", "left_anti")


def without_file(cache: DataFrame, prefix: str | Column) -> DataFrame:
    return cache.where(~F.col("cache_key").startswith(prefix))


def newest(rows: DataFrame, at: str, tie: str, most: int = MOST) -> DataFrame:
    """The ``most`` newest rows: a distributed top-k, each task passes on no more than that."""
    return rows.orderBy(F.col(at).desc(), F.col(tie).desc()).limit(most)


def hit_rate(access_log: DataFrame) -> DataFrame:
    """(n, hits, rate) of an access log with a boolean ``hit``."""
    return access_log.agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits"), F.avg(F.col("hit").cast("int")).alias("rate"))


def job_event(status: Column, error: Column | None = None) -> list[Column]:
    """Columns status, progress and error of a state: 0, 10 or 100 percent; a failed job stays at 10."""
    progress = F.when(status == "PENDING", 0).when(status == "COMPLETED", 100).otherwise(10)
    return [status.alias("status"), progress.cast("long").alias("progress"), F.when(status == "FAILED", error if error is not None else F.lit(None).cast("string")).alias("error")]


def job_status(log: DataFrame) -> DataFrame:
    """The latest event of each job, by (ts, seq)."""
    return latest(log, "job_id", [F.col("ts").desc(), F.col("seq").desc()])


def after_deletes(log: DataFrame, deletes: DataFrame) -> DataFrame:
    """The latest event of each job that no delete (job_id, ts, seq) at or after it has removed; a job that is saved again is there again."""
    gone = deletes.groupBy("job_id").agg(F.max(F.struct("ts", "seq")).alias("gone__"))
    rows = job_status(log).join(gone, "job_id", "left")
    return rows.where(F.col("gone__").isNull() | (F.struct("ts", "seq") > F.col("gone__"))).drop("gone__")


def cache_stats(versions: DataFrame, key: str, at: str, now: Column, access_log: DataFrame, ttl_s: int = CACHE_TTL_S) -> DataFrame:
    """One row (size, hits, reads, evictions, stats): live keys, reads that met one (``hit``), and keys whose last version has expired."""
    last = latest(versions, key, [F.col(at).desc()])
    is_live = F.col(at) > now - F.make_dt_interval(secs=F.lit(ttl_s).cast("decimal(18,6)"))
    sizes = last.agg(F.count_if(is_live).alias("size"), F.count_if(~is_live).alias("evictions"))
    reads = access_log.agg(F.count_if("hit").alias("hits"), F.count(F.lit(1)).alias("reads"))
    rate = F.when(F.col("reads") > 0, F.col("hits") / F.col("reads")).otherwise(F.lit(1.0)) * 100
    return sizes.crossJoin(reads).select("size", "hits", "reads", "evictions", F.format_string("ChunkCache[size=%d, hitRate=%.2f%%, evictions=%d]", "size", rate, "evictions").alias("stats"))


def chunk_states(wanted: DataFrame, cache: DataFrame, failed: DataFrame) -> DataFrame:
    """``wanted`` chunks with ``state``: DONE if the cache has them, else FAILED if a failure is on record, else PENDING. What isn't DONE is what a resumed run has to do."""
    known = cache.select("cache_key").distinct().withColumn("done__", F.lit(True))
    broken = failed.select("cache_key").distinct().withColumn("failed__", F.lit(True))
    rows = wanted.join(known, "cache_key", "left").join(broken, "cache_key", "left")
    return rows.withColumn("state", F.when(F.col("done__"), "DONE").when(F.col("failed__"), "FAILED").otherwise("PENDING")).drop("done__", "failed__")


def partial_results(states: DataFrame) -> DataFrame:
    """(file_id, total, done, failed, complete) of each file."""
    counts = [F.count(F.lit(1)).alias("total"), F.count_if(F.col("state") == "DONE").alias("done"), F.count_if(F.col("state") == "FAILED").alias("failed")]
    return states.groupBy("file_id").agg(*counts).withColumn("complete", F.col("done") == F.col("total"))
