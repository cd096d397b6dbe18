"""Operator 6: benchmark decontamination by winnowing, in DataFrame functions.

A window is ``WINDOW`` consecutive words of an item, or all words of a shorter one. Texts' word k-grams are hashed, and of every ``WINDOW - k + 1``
neighbours the smallest hash is kept, so equal windows always share a kept hash: no shared span of a window's length is missed. Documents'
kept hashes, an entry for each run of windows that keep the same one, meet those of the items; where one is shared, the hit is extended to all windows of its
run, which are then compared as wholes by digest. Words are counted as hit if any such window covers them.

Cost: documents are split and hashed in one pass; nothing is read again, and only words around shared hashes go on. Item hashes are broadcast only if
their counted number is at most ``BROADCAST_ROWS``; otherwise both sides are shuffled, the documents' with the words of their windows.

Rows: null texts and items have no words and no hits; items of one id act together, and items with a null id hit but are not listed; repeated
documents get equal rows each; empty tables on either side work; only doc_id and text, item_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.staging import staged

WINDOW, GRAM = 10, 5
BROADCAST_ROWS = 200_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS l, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT rid, l, i, array_to_string(w[i : i + l - 1], ' ') AS t
  FROM (SELECT rid, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM bw) WHERE len(w) >= l)
), m AS (
  SELECT dw.rid, dw.i, dw.l, bw.item_id FROM dw JOIN bw USING (l, t)
), hit AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + l)) AS p FROM (SELECT DISTINCT rid, i, l FROM m)) GROUP BY rid
), items AS (
  SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM m WHERE item_id IS NOT NULL) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)
"""


def held(column: Column) -> Column:
    """A column that is computed once: the generator is a border that Catalyst doesn't copy expressions across."""
    return F.explode(F.array(column))


def exact_words(text: Column) -> Column:
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(plain, SEPARATORS), lambda w: w != "")


def grams(words: Column, k: int) -> Column:
    """Hashes of all runs of k words, in order; ``words`` must be a plain column."""
    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))


def window_minima(hashes: Column, w: int) -> Column:
    """The smallest of every w neighbouring hashes, in order; ``hashes`` must be a plain column."""
    smallest = (lambda i: F.least(*[F.get(hashes, i + j) for j in range(w)])) if w > 1 else (lambda i: F.get(hashes, i))
    return F.when(F.size(hashes) >= w, F.transform(F.sequence(F.lit(0), F.size(hashes) - w), smallest)).otherwise(F.array().cast("array<bigint>"))


def changes(minima: Column) -> Column:
    """Where a run of equal minima begins, with the length of the array at the end; ``minima`` must be a plain column."""
    places = F.sequence(F.lit(0), F.size(minima) - 1)
    begun = F.filter(places, lambda i: (i == 0) | (F.get(minima, i) != F.get(minima, i - 1)))
    return F.when(F.size(minima) > 0, F.array_append(begun, F.size(minima))).otherwise(F.array().cast("array<int>"))


def fingerprints(minima: Column, starts: Column, length: int) -> Column:
    """array of struct(length, kept, at, n): a run of n windows from ``at`` that keep the same hash. Arguments must be plain columns."""
    last = F.size(starts) - 1

    def entry(i: Column) -> Column:
        at = F.get(starts, i)
        return F.struct(F.lit(length).alias("length"), F.get(minima, at).alias("kept"), at.alias("at"), (F.get(starts, i + 1) - at).alias("n"))

    return F.when(last > 0, F.transform(F.sequence(F.lit(0), last - 1), entry)).otherwise(F.array().cast("array<struct<length:int,kept:bigint,at:int,n:int>>"))


def sizes(length: int) -> tuple[int, int]:
    """(k, number of neighbours) for windows of a length."""
    k = min(GRAM, length)
    return k, length - k + 1


def item_windows(items: DataFrame) -> DataFrame:
    """Distinct (item_id, length, digest, kept hash) of all windows of all items. Hashes and digests are of the same words, of which only A to Z are folded."""
    words = items.select("item_id", held(exact_words(F.col("text"))).alias("words")).where(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(WINDOW))
    starts = words.select("item_id", "words", length.alias("length"), F.explode(F.sequence(F.lit(1), F.size("words") - length + 1)).alias("at"))
    windows = starts.select("item_id", "length", held(F.slice("words", F.col("at"), F.col("length"))).alias("window"))
    windows = windows.select("item_id", "length", digest(F.col("window")).alias("digest"), "window")
    kept = F.lit(None).cast("bigint")
    for n in range(1, WINDOW + 1):
        k, w = sizes(n)
        hashes = [F.xxhash64(*[F.get("window", F.lit(i + j)) for j in range(k)]) for i in range(w)]
        kept = F.when(F.col("length") == n, F.least(*hashes) if w > 1 else hashes[0]).otherwise(kept)
    return windows.select("item_id", "length", "digest", kept.alias("kept")).distinct()


def digest(window: Column) -> Column:
    return F.md5(F.concat_ws(" ", window).cast("binary"))


def matches(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, hits, windows): (doc_id, text_hash, n_words) of every row; distinct (doc_id, text_hash, at, length, digest) of
    occurring item windows, ``at`` from 0; and the items' windows. Documents are keyed by id and text, so repeated rows are worked on once.

    Texts are read once. A fingerprint that meets an item's carries the words of its run of windows, which are then compared; so no text is shuffled.
    """
    windows = staged(item_windows(items), "windows")
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect())
    small = windows.count() <= BROADCAST_ROWS
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    words = rows.select("doc_id", "text_hash", held(exact_words(F.col("text"))).alias("words"))
    stepped = words.select("*", F.size("words").cast("long").alias("n_words"))
    entries = []
    for k in sorted({sizes(n)[0] for n in lengths}):
        stepped = stepped.select("*", held(grams(F.col("words"), k)).alias(f"g{k}"))
    for n in lengths:
        k, w = sizes(n)
        stepped = stepped.select("*", held(window_minima(F.col(f"g{k}"), w)).alias(f"m{n}"))
        stepped = stepped.select("*", held(changes(F.col(f"m{n}"))).alias(f"s{n}"))
        entries.append(fingerprints(F.col(f"m{n}"), F.col(f"s{n}"), n))
    mark = F.struct(F.lit(0).alias("length"), F.lit(0).cast("bigint").alias("kept"), F.lit(0).alias("at"), F.lit(1).alias("n"))
    emitted = stepped.select("doc_id", "text_hash", "n_words", "words", F.explode(F.concat(F.array(mark), *entries)).alias("x")).select("doc_id", "text_hash", "n_words", "words", "x.*")
    known = windows.select("length", "kept").distinct()
    known = known.unionByName(docs.sparkSession.range(1).select(F.lit(0).alias("length"), F.lit(0).cast("bigint").alias("kept")))
    part = F.slice("words", F.col("at") + 1, F.col("n") + F.col("length") - 1).alias("part")
    columns = ["doc_id", "text_hash", "n_words", "length", "at", "n"]
    if small:
        shared = emitted.join(F.broadcast(known), ["length", "kept"]).select(*columns, part)
    else:
        shared = emitted.select(*columns, "kept", part).join(known, ["length", "kept"]).select(*columns, "part")
    shared = staged(shared, "fingerprints")

    starts = shared.where("length > 0").select("doc_id", "text_hash", "length", "part", F.col("at").alias("first"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    placed = starts.select("doc_id", "text_hash", (F.col("first") + F.col("i")).alias("at"), "length", digest(F.slice("part", F.col("i") + 1, F.col("length"))).alias("digest"))
    exact = windows.select("length", "digest").distinct()
    hits = staged(placed.join(F.broadcast(exact) if small else exact, ["length", "digest"]).distinct(), "hits")
    return shared.where("length = 0").select("doc_id", "text_hash", "n_words"), hits, windows


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, item_ids) of every row of ``docs``; ``item_ids`` are strings in order."""
    rows, hits, windows = matches(docs, items)
    key = ["doc_id", "text_hash"]
    order = Window.partitionBy(*key).orderBy("at", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("at") + F.col("length")
    fresh = F.greatest(F.lit(0), end - F.greatest(F.col("at"), F.coalesce(F.max(end).over(order), F.lit(0))))
    n_hit = hits.withColumn("fresh", fresh).groupBy(*key).agg(F.sum("fresh").cast("long").alias("n_hit"))
    named = hits.select(*key, "length", "digest").distinct().join(windows.select("length", "digest", F.col("item_id").cast("string").alias("item")).distinct(), ["length", "digest"])
    named = named.where(F.col("item").isNotNull()).select(*key, "item").distinct().groupBy(*key).agg(F.array_sort(F.collect_list("item")).alias("item_ids"))
    both = n_hit.alias("n").join(named.alias("i"), F.col("n.doc_id").eqNullSafe(F.col("i.doc_id")) & (F.col("n.text_hash") == F.col("i.text_hash")), "left").select("n.*", "item_ids")
    joined = rows.alias("r").join(both.alias("b"), F.col("r.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("r.text_hash") == F.col("b.text_hash")), "left")
    return joined.select("r.*", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6_winnowing: words of every document that items' windows cover."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    sha = F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), sha.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
