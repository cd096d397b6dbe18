"""Operator 9: substring deduplication over a log-structured fingerprint index.

A window is ``WINDOW`` consecutive words. Each window's fingerprint is the smallest hash of the ``GRAM``-word runs in it, the last of equal ones, so equal windows
have equal fingerprints, and neighbouring windows with the same one form a span. The index holds one entry per different span: fingerprint, digest of
the span's words, and the first document that has it. It is a log: each batch of documents, in ascending doc_id, is merged with the sorted runs of all earlier
ones; a span that the index or the batch has under a smaller id is a repeat as a whole; what is new becomes another immutable run; and when there are more
than ``FAN_IN`` runs they are compacted into one.

Spans that share a fingerprint but not their digest may still share windows. The windows of the first documents of such spans are verified one by one by a
128-bit digest. Entries are dealt by fingerprint and digest, so that a fingerprint of many documents with different words around it spreads over tasks; equal spans of one
document are one entry, and entries that a smaller id of the same task has already are known repeats, dealt by their document. Which fingerprints have several spans, and which
windows several documents, is summed before it is shuffled, and joined from tables that Spark can split where a key is hot. No pairs are made.

Rows: null text has no words; texts of fewer than ``WINDOW`` words lose none; repeats within one document or one doc_id stay, since no smaller id has them; null
ids count as larger than all others and equal to each other; repeated rows get equal results; very long texts are worked on whole; an empty table gives no row; only
doc_id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.worker import tidy
from spanloom.staging import staged

WINDOW, GRAM = 50, 8
FAN_IN = 2
#: Keys that may be broadcast.
BROADCAST_ROWS = 200_000
KEY = ["no_id", "row_id", "row_hash"]
MULTIPLIERS = np.random.default_rng(9).integers(1, 1 << 63, 4, dtype=np.uint64) | np.uint64(1)
INVERSES = np.array([pow(int(m), -1, 1 << 64) for m in MULTIPLIERS], np.uint64)

ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT rid, doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h
  FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
), f AS (SELECT h, min(doc_id) AS first FROM s GROUP BY h),
r AS (SELECT DISTINCT rid, p FROM (SELECT rid, unnest(range(i, i + 50)) AS p FROM s JOIN f USING (h) WHERE doc_id > first)),
g AS (SELECT rid, list(p) AS ps FROM r GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE [x FOR x, k IN w IF NOT list_contains(ps, k)] END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (rid)
"""


class Words(dict):
    """Word to a 64-bit hash, for up to about ``most`` words."""

    most = 250_000

    def __missing__(self, word):
        import xxhash

        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class Rolling:
    """Digests of any run of words in constant time, from sums of powers modulo 2**64."""

    def __init__(self, hashes: np.ndarray, which: int):
        n = len(hashes)
        powers = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, MULTIPLIERS[which])])
        self.back = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, INVERSES[which])])
        self.sums = np.r_[np.uint64(0), np.add.accumulate(mix(hashes ^ MULTIPLIERS[which]) * powers[:n])]

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts])


def spans_of(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, digest, windows, places, first windows) of a document's different spans: entry i stands at the next ``places[i]`` first windows."""
    n = len(hashes)
    if n < WINDOW:
        return (np.zeros(0, np.int64),) * 5
    starts = np.arange(n - GRAM + 1)
    grams = Rolling(hashes, 0).of(starts, starts + GRAM)
    width = WINDOW - GRAM + 1
    least = np.empty(n - WINDOW + 1, np.int64)
    for i in range(0, len(least), 1 << 16):
        view = np.lib.stride_tricks.sliding_window_view(grams[i : i + (1 << 16) + width - 1], width)[:, ::-1]
        part = view.argmin(1)
        least[i : i + len(part)] = i + np.arange(len(part)) + width - 1 - part
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    last = np.r_[first[1:], len(least)] - 1
    prints = grams[least[first]].view(np.int64)
    digest = Rolling(hashes, 1).of(first, last + WINDOW).view(np.int64)
    order = np.lexsort((first, digest, prints))
    prints, digest, first, last = prints[order], digest[order], first[order], last[order]
    new = np.flatnonzero(np.r_[True, (prints[1:] != prints[:-1]) | (digest[1:] != digest[:-1])])
    return prints[new], digest[new], (last - first + 1)[new], np.diff(np.r_[new, len(first)]), first


def row_key(docs: DataFrame) -> DataFrame:
    """``docs`` as (no_id, row_id, row_hash, text): plain columns that tell all rows apart but equal ones; rows without an id sort last."""
    row_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("row_id")
    return docs.select(F.col("doc_id").isNull().alias("no_id"), row_id, F.xxhash64("text", F.col("text").isNull()).alias("row_hash"), F.coalesce("text", F.lit("")).alias("text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """A row per document: (no_id, row_id, row_hash, n_words, whole_sha256, spans)."""

    def work(batches):
        import pyarrow as pa

        memo = Words()
        for batch in batches:
            counts, shas, columns, bounds = [], [], [], [0]
            for text in batch.column(3).to_pylist():
                words = text.encode().split()
                counts.append(len(words))
                shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
                columns.append(spans_of(memo.of(words)))
                bounds.append(bounds[-1] + len(columns[-1][0]))
            prints, digests, windows, places, first = (np.concatenate(c) for c in zip(*columns, strict=True))
            at = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(places)], pa.int32()), pa.array(first, pa.int32()))
            values = pa.StructArray.from_arrays([pa.array(prints, pa.int64()), pa.array(digests, pa.int64()), pa.array(windows, pa.int32()), at], names=["print", "digest", "windows", "at"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(counts, pa.int64()), pa.array(shas), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)], names=[*KEY, "n_words", "whole_sha256", "spans"])

    return row_key(docs).mapInArrow(tidy(work), "no_id boolean, row_id long, row_hash long, n_words long, whole_sha256 string, spans array<struct<print:long,digest:long,windows:int,at:array<int>>>")


ENTRY = "print long, digest long, no_id boolean, row_id long, row_hash long, windows int, at array<int>"
ENTRY_NAMES = ["print", "digest", *KEY, "windows", "at"]


def first_of_each(batches):
    """Sorted entries with ``begins`` (the first of its span) and ``repeat`` (a smaller id has the span); rows without an id are one id, the largest."""
    import pyarrow as pa

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = dict(zip(batch.schema.names, batch.columns, strict=True))
        p, d, r = (columns[c].to_numpy(zero_copy_only=False) for c in ("print", "digest", "row_id"))
        no_id = columns["no_id"].to_numpy(zero_copy_only=False)
        begins = np.r_[last is None or (p[0], d[0]) != last[:2], (p[1:] != p[:-1]) | (d[1:] != d[:-1])]
        at = np.maximum.accumulate(np.where(begins, np.arange(len(p)), -1))
        first_no, first = (np.where(at < 0, last[i] if last else 0, x[np.maximum(at, 0)]) for i, x in ((2, no_id), (3, r)))
        last = (p[-1], d[-1], first_no[-1], first[-1])
        repeat = (no_id > first_no) | (no_id == first_no) & (r > first)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(begins), pa.array(repeat)], names=[*batch.schema.names, "begins", "repeat"])


class FingerprintIndex:
    """Sorted immutable runs of span entries, each different span in one run under its first document."""

    def __init__(self, spark: SparkSession):
        self.spark, self.runs = spark, []

    def entries(self) -> DataFrame:
        found = self.spark.createDataFrame([], ENTRY)
        for run in self.runs:
            found = found.unionByName(run)
        return found

    def add(self, batch: DataFrame) -> DataFrame:
        """Merge a batch of entries, all of ids no smaller than those before, and append what is new as a run.

        Returns (no_id, row_id, row_hash, lo, hi, repeat): with ``repeat``, spans of the batch that a smaller id has; without, spans of first documents, old or new,
        whose fingerprint has another span as well, one of them new.
        """
        local = batch.sortWithinPartitions("print", "digest", "no_id", "row_id").mapInArrow(first_of_each, ENTRY + ", begins boolean, repeat boolean")
        rows = local.select(*ENTRY_NAMES, F.lit(False).alias("old"), F.col("repeat").alias("sure"))
        rows = self.entries().select(*ENTRY_NAMES, F.lit(True).alias("old"), F.lit(False).alias("sure")).unionByName(rows)
        known = rows.where("sure").select(*ENTRY_NAMES, F.lit(False).alias("begins"), F.lit(True).alias("repeat"), "old")
        dealt = rows.where("not sure").drop("sure").repartition("print", "digest").sortWithinPartitions("print", "digest", "no_id", "row_id", F.col("old").desc(), "row_hash")
        judged = dealt.mapInArrow(tidy(first_of_each), ENTRY + ", old boolean, begins boolean, repeat boolean").where("not old")
        merged = staged(judged.select(*known.columns).unionByName(known).drop("old"), "index-merge")
        new = merged.where("begins").select(*ENTRY_NAMES)
        firsts = self.entries().select("print", F.lit(0).alias("new")).unionByName(new.select("print", F.lit(1).alias("new")))
        several = firsts.groupBy("print").agg(F.count(F.lit(1)).alias("n"), F.max("new").alias("new")).where("n > 1 and new = 1").select("print")
        several = staged(several, "index-shared")
        own = self.entries().unionByName(merged.where("not repeat").select(*ENTRY_NAMES)).join(several, "print", "left_semi")
        self.runs.append(new)
        spans = merged.where("repeat").select(*KEY, "windows", "at", F.lit(True).alias("repeat")).unionByName(own.select(*KEY, "windows", "at", F.lit(False).alias("repeat")))
        marks = spans.select(*KEY, "windows", F.explode("at").alias("lo"), "repeat")
        marks = marks.select(*KEY, "lo", (F.col("lo") + F.col("windows") - 1).alias("hi"), "repeat")
        if len(self.runs) > FAN_IN:
            self.compact()
        return marks

    def compact(self) -> None:
        """Rewrite all runs as one, in order. The old ones stay for whoever reads them still."""
        self.runs = [staged(self.entries().repartitionByRange("print", "digest").sortWithinPartitions("print", "digest"), "index-run")]


def with_ranges(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(no_id, row_id, row_hash, text, ranges) of the rows that have ``spans``. Where those are at most ``BROADCAST_ROWS``, as counted, the other texts are not shuffled."""
    ranges = staged(spans.groupBy(*KEY).agg(F.collect_set(F.struct("lo", "hi")).alias("ranges")), "ranges")
    rows = row_key(docs)
    if ranges.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(ranges.select(*KEY)), KEY, "left_semi")
    return rows.join(ranges, KEY).select(*KEY, "text", "ranges")


def window_digests(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(no_id, row_id, row_hash, at, w1, w2, sure) of the windows of some spans (no_id, row_id, row_hash, lo, hi). ``sure``: a smaller id of the same batch has the window."""

    def work(batches):
        import pyarrow as pa

        memo = Words()
        for batch in batches:
            parts = []
            for no_id, row_id, row_hash, text, ranges in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hashes = memo.of(text.encode().split())
                at = np.unique(np.concatenate([np.arange(r["lo"], r["hi"] + 1) for r in ranges]))
                w1, w2 = (Rolling(hashes, k).of(at, at + WINDOW).view(np.int64) for k in (2, 3))
                parts.append((np.full(len(at), no_id), np.full(len(at), row_id, np.int64), np.full(len(at), row_hash, np.int64), at, w1, w2))
            if parts:
                columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
                no_id, row_id, _, _, w1, w2 = columns
                order = np.lexsort((row_id, no_id, w2, w1))
                a, b, n, r = w1[order], w2[order], no_id[order], row_id[order]
                begins = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
                lead = np.repeat(begins, np.diff(np.r_[begins, len(a)]))
                sure = np.empty(len(a), bool)
                sure[order] = (n > n[lead]) | (n == n[lead]) & (r > r[lead])
                columns.append(sure)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()], strict=True)], names=[*KEY, "at", "w1", "w2", "sure"])

    return with_ranges(docs, spans).mapInArrow(tidy(work), "no_id boolean, row_id long, row_hash long, at int, w1 long, w2 long, sure boolean")


def cut(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(no_id, row_id, row_hash, text, n_removed, kept_sha256): texts without the words in ``spans`` (no_id, row_id, row_hash, lo, hi), joined by one space."""

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            texts, removed, shas = [], [], []
            for text, ranges in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                words = text.encode().split()
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, [r["lo"] for r in ranges], 1)
                np.add.at(edge, [r["hi"] + WINDOW for r in ranges], -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                texts.append(kept.decode())
                removed.append(int(gone.sum()))
                shas.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.string()), pa.array(removed, pa.int64()), pa.array(shas)], names=[*KEY, "text", "n_removed", "kept_sha256"])

    return with_ranges(docs, spans).mapInArrow(tidy(work), "no_id boolean, row_id long, row_hash long, text string, n_removed long, kept_sha256 string")


def repeats(docs: DataFrame, batches: int = 3) -> tuple[DataFrame, DataFrame]:
    """(documents, spans): the table of :func:`fingerprints`, and (no_id, row_id, row_hash, lo, hi) of all runs of windows that a smaller id has."""
    table = staged(fingerprints(docs), "fingerprints")
    index = FingerprintIndex(docs.sparkSession)
    with_id = table.where("not no_id")
    places = with_id.approxQuantile("row_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    edges = sorted({int(x) for x in places})
    marks = None
    for low, high in zip([None, *edges], [*edges, None], strict=True):
        part = table if low is None else table.where(F.col("no_id") | (F.col("row_id") > low))
        part = part if high is None else part.where(~F.col("no_id") & (F.col("row_id") <= high))
        marked = index.add(part.select(*KEY, F.inline("spans")).select(*ENTRY_NAMES))
        marks = marked if marks is None else marks.unionByName(marked)
    owner = F.struct("no_id", "row_id")
    lane = F.when(F.col("sure"), F.xxhash64(*KEY, "at")).otherwise(F.lit(0))
    first = F.min(owner).over(Window.partitionBy("w1", "w2", "lane"))
    single = window_digests(docs, marks.where("not repeat")).withColumn("lane", lane).withColumn("first", first)
    later = single.where(F.col("sure") | (owner > F.col("first"))).select(*KEY, F.col("at").alias("lo"), F.col("at").alias("hi"))
    return table, staged(marks.where("repeat").drop("repeat").unionByName(later), "repeats")


def deduplicate(docs: DataFrame, batches: int = 3) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""
    table, spans = repeats(docs, batches)
    changed = cut(docs, spans).drop("text").dropDuplicates(KEY)
    doc_id = F.when(~F.col("no_id"), F.col("row_id")).alias("doc_id")
    joined = table.select(*KEY, "n_words", "whole_sha256").join(changed, KEY, "left")
    return joined.select(doc_id, "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9_fingerprint_index: what deduplication leaves of every document."""
    return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
