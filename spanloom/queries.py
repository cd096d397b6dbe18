"""Queries of the timed-text operators over the driver's tables, and the same in DuckDB's SQL.

Documents have no times, so a timeline is derived: half a second a word, segments of eight words, chunks of 120 s every 90 s. All times are multiples of 0.5.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.functions import times
from spanloom.operators import legacy, match, merge
from spanloom.plans import chunking, request, timeline
from spanloom.sources import objects, state, writers
from spanloom.staging import new_path

NOW = "2024-01-01 00:00:00"
STATUS_OF = {"signup": "PENDING", "view": "PROCESSING", "click": "PROCESSING", "purchase": "COMPLETED", "error": "FAILED"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark, sf_dir):
    return timeline.segments_of(table(spark, sf_dir, "documents"), "doc_id", "text")


def files(spark, sf_dir):
    return timeline.within_limit(timeline.files_of(table(spark, sf_dir, "documents"), "doc_id", "text"))


def chunks(spark, sf_dir):
    return chunking.fixed(files(spark, sf_dir))


def rows(spark, sf_dir):
    """Chunk rows of all documents."""
    return timeline.perturbed(timeline.sliced(segments(spark, sf_dir), chunks(spark, sf_dir)))


def varied(spark, sf_dir):
    """Chunk rows in which every branch of a merge occurs: of eight chunks, by file and index, one is empty, one ends early and one has other words."""
    kind = (F.col("file_id") + 3 * F.col("chunk_index")) % 8
    gone = (kind == 3) | (kind == 1) & (F.col("start_s") >= 60)
    found = rows(spark, sf_dir).withColumn("text", F.when(kind == 5, F.translate("text", "abcdefghijklmnopqrstuvwxyz", "bcdefghijklmnopqrstuvwxyza")).otherwise(F.col("text")))
    return found.withColumns({c: F.when(~gone, F.col(c)) for c in ("seg_idx", "start_s", "end_s", "text")})


def chunk_segments(spark, sf_dir):
    return timeline.perturbed(timeline.slice_by_chunks(segments(spark, sf_dir), chunks(spark, sf_dir)))


def segment_tokenize(spark, sf_dir):
    rows = segments(spark, sf_dir)
    text = F.col("text")
    return rows.select("file_id", "seg_idx", F.size(T.words(text)).cast("long").alias("n_words"), T.count_trimmed(text).cast("long").alias("n_trimmed"), T.count_untrimmed(text).cast("long").alias("n_untrimmed"), T.shorten(text, 20).alias("short"))


def normalize_words(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.explode(T.words(F.col("text"))).alias("word"))
    return rows.groupBy(T.normalize(F.col("word")).alias("norm")).agg(F.count(F.lit(1)).alias("n"))


def plan_dynamic_chunks(spark, sf_dir):
    return chunking.dynamic(files(spark, sf_dir), segments(spark, sf_dir))


def plan_dynamic_fixed_clock(spark, sf_dir):
    return chunking.dynamic(files(spark, sf_dir), segments(spark, sf_dir), clock="fixed")


def rebase_absolute(spark, sf_dir):
    rows = chunk_segments(spark, sf_dir).join(chunks(spark, sf_dir).select("file_id", "chunk_index", "start_time"), ["file_id", "chunk_index"])
    return rows.select("file_id", "chunk_index", "seg_idx", *[timeline.absolute(F.col("start_time"), F.col(c)).alias(c) for c in ("start_s", "end_s")])


def overlap_region(spark, sf_dir):
    return match.overlap_region(chunk_segments(spark, sf_dir), chunks(spark, sf_dir))


def longest_match(spark, sf_dir):
    return match.longest_match_of(rows(spark, sf_dir)).withColumn("matched", F.array_join("matched", " "))


def drop_matched_prefix(spark, sf_dir):
    return merge.merge_pairs_of(rows(spark, sf_dir)).where("branch = 'match'").drop("branch", "keep_before")


def merge_pairwise(spark, sf_dir):
    return merge.merge_pairs_of(rows(spark, sf_dir)).drop("keep_before")


def merge_transcript(spark, sf_dir):
    return merge.merge_transcripts_of(rows(spark, sf_dir))


def merge_varied(spark, sf_dir):
    return merge.merge_transcripts_of(varied(spark, sf_dir))


def merge_branches(spark, sf_dir):
    found = varied(spark, sf_dir)
    whole = found.where("seg_idx is not null").select("file_id", "chunk_index", "seg_idx", "start_s", "end_s", "text")
    return merge.decisions(whole, chunks(spark, sf_dir))


def timestamp_fallback(spark, sf_dir):
    return merge.merge_pairs_of(varied(spark, sf_dir)).where("branch = 'timestamp'").drop("branch", "keep_before")


def timestamp_after_word(spark, sf_dir):
    return merge.after_word(chunk_segments(spark, sf_dir), F.lit(60))


def starting_after(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return merge.starting_after(chunk_segments(spark, sf_dir), c, c.select("file_id", "chunk_index", (F.col("start_time") + 30.0).alias("start_at")))


def first_words_dropped(spark, sf_dir):
    return merge.drop_first_words(chunk_segments(spark, sf_dir), F.lit(60))


def word_jaccard(spark, sf_dir):
    order = Window.partitionBy("file_id").orderBy("seg_idx")
    rows = segments(spark, sf_dir).withColumns({"prev": F.lag("text").over(order), "prev_start": F.lag("start_s").over(order)}).where("prev is not null")
    return rows.select("file_id", "seg_idx", F.round(T.jaccard(F.col("prev"), F.col("text")), 9).alias("similarity"), times.near(F.col("prev_start"), F.col("start_s"), 4.5).alias("near"))


def legacy_dedup_merge(spark, sf_dir):
    return legacy.dedup_merge(timeline.slice_by_chunks(segments(spark, sf_dir), chunks(spark, sf_dir)), chunks(spark, sf_dir))


def legacy_dedup_counts(spark, sf_dir):
    return legacy.removed(timeline.slice_by_chunks(segments(spark, sf_dir), chunks(spark, sf_dir)), chunks(spark, sf_dir))


def turns(spark, sf_dir):
    """Conversations as transcripts: a turn is a segment, half a second a word."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_id"), F.col("turn").alias("seq"), F.col("role").alias("language"), "text", T.count_trimmed(F.col("text")).alias("n"))
    order = Window.partitionBy("file_id").orderBy("seq")
    end = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) * 0.5
    return rows.withColumn("end_s", end).withColumn("start_s", F.col("end_s") - F.col("n") * 0.5)


def srt_lines(spark, sf_dir):
    return writers.srt_lines(turns(spark, sf_dir))


def srt_document(spark, sf_dir):
    return writers.srt_documents(turns(spark, sf_dir))


def json_document(spark, sf_dir):
    found = turns(spark, sf_dir)
    return writers.json_documents(found, timeline.first_language(found.withColumnRenamed("seq", "chunk_index")))


def written(spark, sf_dir):
    """SRT documents of the conversations, written as objects under their live names: (key, path, length)."""
    named = srt_document(spark, sf_dir).withColumn("source", F.format_string("talks/%d.mp3", "file_id"))
    return writers.write_objects(writers.output_keys(named, "source").withColumnRenamed("srt_key", "key"), new_path(spark, "objects"), body="srt")


def object_heads(spark, sf_dir):
    found = written(spark, sf_dir)
    root = F.regexp_replace("path", "/talks/.*$", "")
    at = found.select(root.alias("root")).first()
    listed = objects.heads(spark, f"{at['root']}/talks") if at else found.select("path", "length")
    return listed.select(F.regexp_extract("path", "talks/[^/]*$", 0).alias("key"), "length")


def object_ranges(spark, sf_dir):
    found = objects.ranges(written(spark, sf_dir).select("path", F.lit(3).alias("first"), F.lit(40).alias("last")))
    return found.select(F.regexp_extract("path", "talks/[^/]*$", 0).alias("key"), F.lower(F.hex("content")).alias("content"))


def response_segments(spark, sf_dir):
    return objects.parsed(objects.responses(chunk_segments(spark, sf_dir)))


class Metronome:
    """A recogniser for tests of the path: one segment of at most 30 s after the other; every third chunk fails at first."""

    def __init__(self):
        self.failed = set()

    def transcribe(self, file_id: int, chunk_index: int, start: float, end: float) -> list[tuple[float, float, str]]:
        if (file_id + chunk_index) % 3 == 0 and (file_id, chunk_index) not in self.failed:
            self.failed.add((file_id, chunk_index))
            raise OSError("try again")
        return [(t, min(t + 30.0, end - start), f"file {file_id} part {chunk_index} beat {i}") for i in range(int(-(-(end - start) // 30))) for t in [30.0 * i]]


def transcribed(spark, sf_dir):
    return objects.transcribe(chunks(spark, sf_dir), Metronome(), pause_s=0.0)


def request_defaults(spark, sf_dir):
    number = F.col("page_id").cast("int")
    wanted = table(spark, sf_dir, "pages").select(
        "page_id", F.when(number % 5 == 0, F.lit(" ")).otherwise(F.lit("audio")).alias("bucket"), F.when(number % 7 == 0, F.lit(None)).otherwise(F.col("url")).alias("key"),
        F.when(number % 3 > 0, number % 4000).alias("chunk_seconds"), F.when(number % 2 > 0, number % 150).alias("min_overlap_seconds"), F.when(number % 4 == 0, F.lit(False)).alias("save"),
    )
    return request.checked(wanted).withColumn("wrong", F.array_join("wrong", ",")).drop("key")


def first_language(spark, sf_dir):
    return timeline.first_language(turns(spark, sf_dir).withColumnRenamed("seq", "chunk_index"))


def output_keys(spark, sf_dir):
    rows = writers.output_keys(table(spark, sf_dir, "pages").select("page_id", "url"), "url")
    return rows.select("page_id", "json_key", "srt_key", "clash", times.transcript_name(F.col("url"), ".json").alias("json_name"), times.transcript_name(F.col("url"), ".srt").alias("srt_name"))


def keyed_chunks(spark, sf_dir):
    span = F.col("end_time") - F.col("start_time")
    name = F.col("file_id").cast("string")
    return chunks(spark, sf_dir).select(times.cache_key(F.lit("audio"), name, F.col("start_time"), span).alias("cache_key"), times.chunk_key(F.lit("audio"), name, F.col("chunk_index"), F.col("start_time"), F.col("end_time")).alias("chunk_key"), "file_id", "chunk_index")


def cache_table(spark, sf_dir):
    """Every third chunk was written, hour by hour before ``NOW``; what is a day old has expired."""
    return state.live(cache_versions(spark, sf_dir), "cache_key", "written_at", F.lit(NOW).cast("timestamp"), state.CACHE_TTL_S)


def cache_hits(spark, sf_dir):
    return state.hits(keyed_chunks(spark, sf_dir), cache_table(spark, sf_dir))


def cache_misses(spark, sf_dir):
    return state.misses(keyed_chunks(spark, sf_dir), cache_table(spark, sf_dir))


def cache_evict_file(spark, sf_dir):
    return state.without_file(cache_table(spark, sf_dir), "audio:3:").select("cache_key", "file_id", "chunk_index")


def cache_evict_key(spark, sf_dir):
    kept = state.without_key(cache_table(spark, sf_dir), keyed_chunks(spark, sf_dir).where("chunk_index = 0"))
    return kept.select("cache_key", "file_id", "chunk_index")


def cache_hit_rate(spark, sf_dir):
    known = cache_table(spark, sf_dir).select("cache_key", F.lit(True).alias("known"))
    return state.hit_rate(keyed_chunks(spark, sf_dir).join(known, "cache_key", "left").select(F.coalesce("known", F.lit(False)).alias("hit")))


def cache_versions(spark, sf_dir):
    rows = keyed_chunks(spark, sf_dir).where("(file_id + chunk_index) % 3 = 0")
    return rows.withColumn("written_at", F.lit(NOW).cast("timestamp") - F.make_dt_interval(hours=(F.col("file_id") % 48).cast("int")))


def cache_stats(spark, sf_dir):
    known = cache_table(spark, sf_dir).select("cache_key", F.lit(True).alias("known"))
    log = keyed_chunks(spark, sf_dir).join(known, "cache_key", "left").select(F.coalesce("known", F.lit(False)).alias("hit"))
    return state.cache_stats(cache_versions(spark, sf_dir), "cache_key", "written_at", F.lit(NOW).cast("timestamp"), log)


def chunk_states(spark, sf_dir):
    wanted = keyed_chunks(spark, sf_dir)
    return state.chunk_states(wanted, cache_table(spark, sf_dir), wanted.where("(file_id + 2 * chunk_index) % 7 = 0"))


def partial_results(spark, sf_dir):
    return state.partial_results(chunk_states(spark, sf_dir))


def job_log(spark, sf_dir):
    status = F.element_at(F.create_map(*[F.lit(x) for kv in STATUS_OF.items() for x in kv]), F.col("event_type"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), "ts", *state.job_event(status, F.col("event_type")))


def job_latest_status(spark, sf_dir):
    return state.job_status(job_log(spark, sf_dir)).select("job_id", "seq", "status", "progress", "error")


def job_live(spark, sf_dir):
    log = job_log(spark, sf_dir)
    now = log.agg(F.max("ts")).first()[0]
    return state.fresh(state.job_status(log), "ts", F.lit(now), state.JOB_TTL_S).select("job_id", "seq", "status")


def job_after_delete(spark, sf_dir):
    """Jobs whose last event isn't followed by a delete; clicks stand for deletes."""
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("status"))
    return state.after_deletes(log.where("status <> 'click'"), log.where("status = 'click'")).select("job_id", "seq", "status")


def retention_topk(spark, sf_dir):
    return state.newest(job_log(spark, sf_dir), "ts", "seq").select("job_id", "seq", "status")


def silence_plan(spark, sf_dir):
    return chunking.at_silences(files(spark, sf_dir), spaced(spark, sf_dir), most_s=120.0, look_s=60.0)


def spaced(spark, sf_dir):
    """Segments with a silence of a second and a half at the end of every fifth."""
    return segments(spark, sf_dir).withColumn("end_s", F.when(F.col("seg_idx") % 5 == 4, F.col("end_s") - 1.5).otherwise(F.col("end_s")))


def concat_merge(spark, sf_dir):
    plain = chunking.fixed(files(spark, sf_dir), 120.0, 0.0)
    return timeline.concatenated(timeline.slice_by_chunks(segments(spark, sf_dir), plain), plain)


def segment_aggregate(spark, sf_dir):
    return timeline.aggregated(chunk_segments(spark, sf_dir))


def chunk_preview(spark, sf_dir):
    first, last = times.estimated_bytes(F.col("start_time"), F.col("end_time"))
    return chunks(spark, sf_dir).select("file_id", "chunk_index", "start_time", "end_time", first.alias("first_byte"), last.alias("last_byte"))


def chunk_counts(spark, sf_dir):
    rows = merge_transcript(spark, sf_dir).groupBy("file_id").agg(F.count(F.lit(1)).alias("total_segments"))
    totals = chunks(spark, sf_dir).groupBy("file_id").agg(F.count(F.lit(1)).alias("total_chunks"))
    return totals.join(rows, "file_id", "left").select("file_id", "total_chunks", F.coalesce("total_segments", F.lit(0)).alias("total_segments"))


def queries() -> dict:
    named = [
        segment_tokenize, normalize_words, plan_dynamic_chunks, plan_dynamic_fixed_clock, chunk_segments, rebase_absolute, overlap_region,
        longest_match, drop_matched_prefix, first_words_dropped, merge_pairwise, merge_transcript, merge_varied, merge_branches, chunk_counts,
        timestamp_fallback, timestamp_after_word, starting_after, word_jaccard, legacy_dedup_merge, legacy_dedup_counts,
        srt_lines, srt_document, json_document, first_language, output_keys, object_heads, object_ranges, response_segments, transcribed, request_defaults,
        cache_hits, cache_misses, cache_evict_file, cache_evict_key, cache_hit_rate, cache_stats, chunk_states, partial_results,
        job_latest_status, job_live, job_after_delete, retention_topk, silence_plan, concat_merge, segment_aggregate, chunk_preview,
    ]
    return {"plan_fixed_chunks": chunks} | {f.__name__: f for f in named}


W = r"[x FOR x IN regexp_split_to_array(text, '\s+') IF x <> '']"
FILES = f"files AS (SELECT doc_id AS file_id, CAST(floor(len({W}) * 0.5) AS BIGINT) AS duration_s FROM documents)"
SEGMENTS = f"""seg AS (
  SELECT file_id, k AS seg_idx, 4.0::DOUBLE * k AS start_s, 0.5::DOUBLE * least(8 * k + 8, len(w)) AS end_s, array_to_string(w[8 * k + 1 : 8 * k + 8], ' ') AS text
  FROM (SELECT file_id, w, unnest(range(0, CAST(ceil(len(w) / 8.0) AS BIGINT))) AS k FROM (SELECT doc_id AS file_id, {W} AS w FROM documents))
)"""


def _chunks(overlap: int, name: str = "ch") -> str:
    stride = 120 - overlap
    return f"""{name} AS (
  SELECT file_id, i AS chunk_index, {stride}.0::DOUBLE * i AS start_time, CAST(least({stride} * i + 120, duration_s) AS DOUBLE) AS end_time
  FROM (SELECT file_id, duration_s, unnest(range(0, greatest(CAST(ceil((duration_s - {overlap}) / {stride}.0) AS BIGINT), 1))) AS i FROM files WHERE duration_s > 0)
)"""


CHUNKS = _chunks(30)
PLAIN_CS = "pcs AS (SELECT file_id, chunk_index, seg_idx, start_s - start_time AS start_s, end_s - start_time AS end_s, text FROM seg JOIN ch USING (file_id) WHERE start_s >= start_time AND start_s < end_time)"
CS = PLAIN_CS + ", cs AS (SELECT * REPLACE (CASE WHEN chunk_index % 2 = 1 THEN translate(text, 'abcdefghijklmnopqrstuvwxyz,', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE text END AS text) FROM pcs)"
BASE = f"{FILES}, {SEGMENTS}, {CHUNKS}, {CS}"
NORM = "trim(translate(lower(w), '.,!?;:''\"', ''))"
OVERLAP = """ov AS (
  SELECT c.file_id, c.chunk_index, s.seg_idx, s.start_s, s.end_s, s.text
  FROM ch c JOIN ch p ON c.file_id = p.file_id AND c.chunk_index = p.chunk_index + 1 JOIN cs s ON s.file_id = p.file_id AND s.chunk_index = p.chunk_index
  WHERE s.start_s >= c.start_time - p.start_time
)"""


VARIED = """cs AS (
  SELECT * REPLACE (CASE WHEN (file_id + 3 * chunk_index) % 8 = 5 THEN translate(text, 'abcdefghijklmnopqrstuvwxyz', 'bcdefghijklmnopqrstuvwxyza') ELSE text END AS text)
  FROM cs0 WHERE (file_id + 3 * chunk_index) % 8 <> 3 AND NOT ((file_id + 3 * chunk_index) % 8 = 1 AND start_s >= 60)
)"""
VARIED_BASE = f"{BASE.replace(', cs AS (', ', cs0 AS (')}, {VARIED}"


def _words(source: str, name: str) -> str:
    return f"""{name} AS (
  SELECT file_id, chunk_index, row_number() OVER (PARTITION BY file_id, chunk_index ORDER BY seg_idx, i) - 1 AS p, w, {NORM} AS norm
  FROM (SELECT file_id, chunk_index, seg_idx, unnest(ws) AS w, unnest(range(0, len(ws))) AS i FROM (SELECT *, {W} AS ws FROM {source}))
)"""


MATCH = f"""{OVERLAP}, {_words("ov", "w1")}, {_words("(SELECT * FROM cs WHERE chunk_index > 0)", "w2")}, met AS (
  SELECT file_id, chunk_index, w1.p AS p1, w2.p - w1.p AS dg FROM w1 JOIN w2 USING (file_id, chunk_index, norm)
), runs AS (
  SELECT file_id, chunk_index, dg, min(p1) AS s1, count(*) AS n
  FROM (SELECT *, p1 - row_number() OVER (PARTITION BY file_id, chunk_index, dg ORDER BY p1) AS isl FROM met) GROUP BY file_id, chunk_index, dg, isl
), lm AS (
  SELECT file_id, chunk_index, n AS match_length, s1 + n AS text1_end, s1 + dg AS text2_start
  FROM (SELECT *, row_number() OVER (PARTITION BY file_id, chunk_index ORDER BY n DESC, s1, s1 + dg) AS r FROM runs WHERE n >= 3) WHERE r = 1
)"""
MATCHED = """SELECT file_id, chunk_index, match_length, text1_end, text2_start, string_agg(w, ' ' ORDER BY p) AS matched
FROM lm JOIN w1 USING (file_id, chunk_index) WHERE p >= text1_end - match_length AND p < text1_end GROUP BY ALL"""
MERGE = rf"""{MATCH}, st AS (
  SELECT file_id, chunk_index, count(*) AS n, max(start_s) AS last_start, arg_max(end_s, seg_idx) AS last_end FROM cs GROUP BY file_id, chunk_index
), kn AS (
  SELECT ch.*, coalesce(n, 0) AS n, lag(coalesce(n, 0)) OVER o AS pn, lag(start_time) OVER o AS ps, lag(last_start) OVER o AS pls, lag(last_end) OVER o AS ple, lead(chunk_index) OVER o IS NULL AS is_last
  FROM ch LEFT JOIN st USING (file_id, chunk_index) WINDOW o AS (PARTITION BY file_id ORDER BY chunk_index)
), de AS (
  SELECT kn.*, match_length, text2_start,
    CASE WHEN is_last THEN NULL ELSE min(CASE WHEN NOT is_last THEN end_time END) OVER (PARTITION BY file_id ORDER BY chunk_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) END AS keep_before,
    CASE WHEN pn IS NULL THEN 'first' WHEN pn = 0 THEN 'prev_empty' WHEN n = 0 THEN 'cur_empty' WHEN pls < start_time - ps THEN 'no_overlap' WHEN match_length IS NULL THEN 'timestamp' ELSE 'match' END AS branch
  FROM kn LEFT JOIN lm USING (file_id, chunk_index)
), mp AS (
  SELECT file_id, chunk_index, seg_idx, start_time + start_s AS start_s, start_time + end_s AS end_s, text, branch, keep_before
  FROM (SELECT *, coalesce(sum(len(regexp_split_to_array(trim(text), '\s+'))) OVER (PARTITION BY file_id, chunk_index ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM cs) JOIN de USING (file_id, chunk_index)
  WHERE before >= CASE WHEN branch = 'match' THEN text2_start + match_length ELSE 0 END AND (branch <> 'timestamp' OR start_time + start_s >= ps + ple)
), mt AS (
  SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY chunk_index, seg_idx) - 1 AS seq, chunk_index, seg_idx, start_s, end_s, text FROM mp WHERE keep_before IS NULL OR start_s < keep_before
)"""
TURNS = r"""tn AS (
  SELECT conv_id AS file_id, turn AS seq, role AS language, text, sum(n) OVER o * 0.5::DOUBLE AS end_s, (sum(n) OVER o - n) * 0.5::DOUBLE AS start_s
  FROM (SELECT *, len(regexp_split_to_array(trim(text), '\s+')) AS n FROM conversations) WINDOW o AS (PARTITION BY conv_id ORDER BY turn)
)"""


def _code(s: str) -> str:
    return f"printf('%02d:%02d:%02d,%03d', CAST(trunc({s} / 3600) AS BIGINT), CAST(trunc(({s} % 3600) / 60) AS BIGINT), CAST(trunc({s} % 60) AS BIGINT), CAST(trunc(({s} - floor({s})) * 1000) AS BIGINT))"


LINES = f"{TURNS}, ln AS (SELECT file_id, seq, row_number() OVER (PARTITION BY file_id ORDER BY seq) || chr(10) || {_code('start_s')} || ' --> ' || {_code('end_s')} || chr(10) || text || chr(10) || chr(10) AS block FROM tn)"
KEYED = f"""{FILES}, {CHUNKS}, kc AS (
  SELECT printf('%s:%s:%.2f:%.2f', 'audio', CAST(file_id AS VARCHAR), start_time, end_time - start_time) AS cache_key, printf('%s:%s:chunk-%d:%.2f-%.2f', 'audio', CAST(file_id AS VARCHAR), chunk_index, start_time, end_time) AS chunk_key, file_id, chunk_index FROM ch
), ca AS (SELECT * FROM kc WHERE (file_id + chunk_index) % 3 = 0 AND file_id % 48 < 24)"""
JOBS = "jl AS (SELECT user_id AS job_id, event_id AS seq, ts, event_type, CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' ELSE 'PROCESSING' END AS status FROM events), la AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, seq DESC) AS r FROM jl) WHERE r = 1)"


#: Words of the older merge and its fold, a step a segment; ``recent`` holds the last ten kept.
LEGACY = rf"""WITH RECURSIVE {FILES}, {SEGMENTS}, {CHUNKS}, {PLAIN_CS}, sg AS (
  SELECT file_id, chunk_index, seg_idx, start_time + start_s AS a, start_time + end_s AS b, text, regexp_split_to_array(lower(text), '\s+') AS w,
    row_number() OVER (PARTITION BY file_id ORDER BY chunk_index, seg_idx) AS i
  FROM pcs JOIN ch USING (file_id, chunk_index)
), fold AS (
  SELECT DISTINCT file_id, 0::BIGINT AS i, 0.0::DOUBLE AS last_end, CAST([] AS STRUCT(a DOUBLE, b DOUBLE, w VARCHAR[])[]) AS recent, true AS kept FROM sg
  UNION ALL
  SELECT file_id, i, CASE WHEN kept THEN greatest(last_end, b) ELSE last_end END, CASE WHEN kept THEN list_append(recent, {{'a': a, 'b': b, 'w': w}})[-10:] ELSE recent END, kept
  FROM (
    SELECT s.file_id, s.i, s.a, s.b, s.w, last_end, recent, NOT (s.a < last_end AND len([r FOR r IN recent IF abs(r.a - s.a) < 1 AND abs(r.b - s.b) < 1
      AND len([x FOR x IN r.w IF list_contains(s.w, x)]) >= 0.7 * (len(r.w) + len(s.w) - len([x FOR x IN r.w IF list_contains(s.w, x)]))]) > 0) AS kept
    FROM fold f JOIN sg s ON s.file_id = f.file_id AND s.i = f.i + 1)
)"""
SILENCE = f"""WITH RECURSIVE {FILES}, {SEGMENTS}, sp AS (SELECT file_id, seg_idx, start_s, end_s - CASE WHEN seg_idx % 5 = 4 THEN 1.5 ELSE 0 END AS end_s FROM seg),
gaps AS (SELECT file_id, end_s AS a, nxt AS b FROM (SELECT *, lead(start_s) OVER (PARTITION BY file_id ORDER BY seg_idx) AS nxt FROM sp) WHERE nxt - end_s >= 1),
plan AS (
  SELECT file_id, 0::BIGINT AS idx, 0.0::DOUBLE AS pos, CAST(duration_s AS DOUBLE) AS total FROM files WHERE duration_s > 0
  UNION ALL
  SELECT file_id, idx + 1, coalesce(cut, pos + 120), total FROM (
    SELECT p.file_id, p.idx, p.pos, p.total, arg_max((a + b) / 2, (b - a) * 1e7 - a) AS cut
    FROM plan p LEFT JOIN gaps g ON g.file_id = p.file_id AND g.a >= p.pos + 60 AND g.b <= p.pos + 120
    WHERE p.pos + 120 < p.total GROUP BY p.file_id, p.idx, p.pos, p.total)
)
SELECT file_id, idx AS chunk_index, pos AS start_time, coalesce(lead(pos) OVER (PARTITION BY file_id ORDER BY idx), total) AS end_time FROM plan"""
REQUESTS = r"""WITH r AS (
  SELECT page_id, CASE WHEN page_id % 5 = 0 THEN ' ' ELSE 'audio' END AS bucket, CASE WHEN page_id % 7 = 0 THEN NULL ELSE url END AS key,
    CASE WHEN page_id % 3 > 0 THEN CAST(page_id % 4000 AS INT) ELSE 3600 END AS chunk_seconds, CASE WHEN page_id % 2 > 0 THEN CAST(page_id % 150 AS INT) ELSE 30 END AS min_overlap_seconds,
    page_id % 4 <> 0 AS save
  FROM pages
)
SELECT page_id, bucket, chunk_seconds, min_overlap_seconds, save, concat_ws(',', CASE WHEN trim(bucket) = '' THEN 'bucket' END, CASE WHEN coalesce(trim(key), '') = '' THEN 'key' END,
  CASE WHEN chunk_seconds NOT BETWEEN 10 AND 3600 THEN 'chunk_seconds' END, CASE WHEN min_overlap_seconds NOT BETWEEN 30 AND 120 THEN 'min_overlap_seconds' END) AS wrong
FROM r"""
JSON = r"""SELECT file_id, '{' || chr(10) || '  "language" : ' || to_json(coalesce(arg_min(language, seq), 'en'))::VARCHAR || ',' || chr(10) || '  "segments" : [ ' || string_agg('{' || chr(10)
  || '    "start" : ' || CAST(start_s AS VARCHAR) || ',' || chr(10) || '    "end" : ' || CAST(end_s AS VARCHAR) || ',' || chr(10) || '    "text" : ' || to_json(text)::VARCHAR || chr(10)
  || '  }', ', ' ORDER BY seq) || ' ]' || chr(10) || '}' AS json FROM tn GROUP BY file_id"""


def _dynamic(clock: str) -> str:
    end = "pos + dur" if clock == "compat" else "dur"
    return rf"""WITH RECURSIVE {FILES}, {SEGMENTS}, sw AS (SELECT file_id, seg_idx, start_s, end_s, len(regexp_split_to_array(text, '\s+')) AS n FROM seg), plan AS (
  SELECT file_id, 0::BIGINT AS idx, 0.0::DOUBLE AS pos, CAST(least(120, duration_s) AS DOUBLE) AS dur, CAST(duration_s AS DOUBLE) AS total FROM files WHERE duration_s > 0
  UNION ALL
  SELECT file_id, idx + 1, nxt, least(120.0::DOUBLE, total - nxt), total FROM (
    SELECT file_id, idx, total, pos + dur - CASE WHEN inside = 0 THEN 30.0 WHEN words >= 5 THEN fin - first_start ELSE 60.0 END AS nxt FROM (
      SELECT p.file_id, p.idx, p.total, p.pos, p.dur, any_value(p.fin) AS fin, count(s.file_id) AS inside,
        coalesce(sum(s.n) FILTER (s.start_s - p.pos < p.fin AND s.end_s - p.pos > p.fin - 30), 0) AS words,
        arg_min(s.start_s - p.pos, s.seg_idx) FILTER (s.start_s - p.pos < p.fin AND s.end_s - p.pos > p.fin - 30) AS first_start
      FROM (SELECT *, {end} AS fin FROM plan) p LEFT JOIN sw s ON s.file_id = p.file_id AND s.start_s >= p.pos AND s.start_s < p.pos + p.dur
      WHERE p.pos + p.dur < p.total GROUP BY p.file_id, p.idx, p.total, p.pos, p.dur)))
SELECT file_id, idx AS chunk_index, pos AS start_time, pos + dur AS end_time FROM plan"""


def oracle_sql() -> dict[str, str]:
    return {
        "segment_tokenize": rf"WITH {SEGMENTS} SELECT file_id, seg_idx, CAST(len({W}) AS BIGINT) AS n_words, CAST(len(regexp_split_to_array(trim(text), '\s+')) AS BIGINT) AS n_trimmed, CAST(len(regexp_split_to_array(rtrim(text), '\s+')) AS BIGINT) AS n_untrimmed, CASE WHEN length(text) > 20 THEN substr(text, 1, 20) || '...' ELSE text END AS short FROM seg",
        "normalize_words": f"SELECT {NORM} AS norm, count(*) AS n FROM (SELECT unnest({W}) AS w FROM documents) GROUP BY 1",
        "plan_fixed_chunks": f"WITH {FILES}, {CHUNKS} SELECT * FROM ch",
        "plan_dynamic_chunks": _dynamic("compat"),
        "plan_dynamic_fixed_clock": _dynamic("fixed"),
        "chunk_segments": f"WITH {BASE} SELECT * FROM cs",
        "rebase_absolute": f"WITH {BASE} SELECT file_id, chunk_index, seg_idx, start_time + start_s AS start_s, start_time + end_s AS end_s FROM cs JOIN ch USING (file_id, chunk_index)",
        "overlap_region": f"WITH {BASE}, {OVERLAP} SELECT * FROM ov",
        "longest_match": f"WITH {BASE}, {MATCH} {MATCHED}",
        "drop_matched_prefix": f"WITH {BASE}, {MERGE} SELECT file_id, chunk_index, seg_idx, start_s, end_s, text FROM mp WHERE branch = 'match'",
        "first_words_dropped": rf"WITH {BASE} SELECT file_id, chunk_index, seg_idx, start_s, end_s, text FROM (SELECT *, coalesce(sum(len(regexp_split_to_array(trim(text), '\s+'))) OVER (PARTITION BY file_id, chunk_index ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM cs) WHERE before >= 60",
        "merge_pairwise": f"WITH {BASE}, {MERGE} SELECT * EXCLUDE (keep_before) FROM mp",
        "merge_transcript": f"WITH {BASE}, {MERGE} SELECT * FROM mt",
        "chunk_counts": f"WITH {BASE}, {MERGE} SELECT file_id, total_chunks, coalesce(total_segments, 0) AS total_segments FROM (SELECT file_id, count(*) AS total_chunks FROM ch GROUP BY 1) LEFT JOIN (SELECT file_id, count(*) AS total_segments FROM mt GROUP BY 1) USING (file_id)",
        "timestamp_fallback": f"WITH {VARIED_BASE}, {MERGE} SELECT file_id, chunk_index, seg_idx, start_s, end_s, text FROM mp WHERE branch = 'timestamp'",
        "merge_varied": f"WITH {VARIED_BASE}, {MERGE} SELECT * FROM mt",
        "merge_branches": f"WITH {VARIED_BASE}, {MERGE} SELECT file_id, chunk_index, branch FROM de",
        "timestamp_after_word": rf"WITH {BASE}, wb AS (SELECT *, sum(len(regexp_split_to_array(trim(text), '\s+'))) OVER (PARTITION BY file_id, chunk_index ORDER BY seg_idx) AS upto FROM cs) SELECT file_id, chunk_index, coalesce(arg_min(end_s, seg_idx) FILTER (upto >= 60), arg_max(end_s, seg_idx)) AS at FROM wb GROUP BY file_id, chunk_index",
        "starting_after": f"WITH {BASE} SELECT file_id, chunk_index, seg_idx, start_time + start_s AS start_s, start_time + end_s AS end_s, text FROM cs JOIN ch USING (file_id, chunk_index) WHERE start_s >= 30",
        "word_jaccard": rf"WITH {SEGMENTS}, pr AS (SELECT file_id, seg_idx, start_s, lag(start_s) OVER o AS ps, regexp_split_to_array(lower(lag(text) OVER o), '\s+') AS a, regexp_split_to_array(lower(text), '\s+') AS b FROM seg WINDOW o AS (PARTITION BY file_id ORDER BY seg_idx)), cm AS (SELECT *, len([x FOR x IN a IF list_contains(b, x)]) AS c FROM pr WHERE a IS NOT NULL) SELECT file_id, seg_idx, round(c / (len(a) + len(b) - c), 9) AS similarity, abs(ps - start_s) < 4.5 AS near FROM cm",
        "srt_lines": f"WITH {LINES} SELECT * FROM ln",
        "srt_document": f"WITH {LINES} SELECT file_id, string_agg(block, '' ORDER BY seq) AS srt FROM ln GROUP BY file_id",
        "json_document": f"WITH {TURNS} {JSON}",
        "legacy_dedup_merge": f"{LEGACY} SELECT file_id, chunk_index, seg_idx, a AS start_s, b AS end_s, text FROM sg JOIN fold USING (file_id, i) WHERE kept",
        "legacy_dedup_counts": f"{LEGACY} SELECT file_id, chunk_index, count(*) FILTER (NOT kept) AS duplicates_removed, CAST(coalesce(sum(length(text) + length(regexp_replace(text, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'))) FILTER (NOT kept), 0) AS BIGINT) AS chars_removed FROM sg JOIN fold USING (file_id, i) GROUP BY file_id, chunk_index",
        "silence_plan": SILENCE,
        "request_defaults": REQUESTS,
        "response_segments": f"WITH {BASE} SELECT * REPLACE (seg_idx - min(seg_idx) OVER (PARTITION BY file_id, chunk_index) AS seg_idx) FROM cs",
        "transcribed": f"WITH {FILES}, {CHUNKS} SELECT file_id, chunk_index, i AS seg_idx, 30.0::DOUBLE * i AS start_s, least(30.0::DOUBLE * i + 30, end_time - start_time) AS end_s, 'file ' || file_id || ' part ' || chunk_index || ' beat ' || i AS text FROM (SELECT *, unnest(range(0, CAST(ceil((end_time - start_time) / 30) AS BIGINT))) AS i FROM ch)",
        "object_heads": f"WITH {LINES} SELECT 'talks/' || file_id || '.srt' AS key, CAST(strlen(string_agg(block, '' ORDER BY seq)) AS BIGINT) AS length FROM ln GROUP BY file_id",
        "object_ranges": f"WITH {LINES} SELECT 'talks/' || file_id || '.srt' AS key, lower(substr(hex(encode(string_agg(block, '' ORDER BY seq))), 7, 76)) AS content FROM ln GROUP BY file_id",
        "cache_stats": f"WITH {KEYED}, x AS (SELECT (SELECT count(*) FROM ca) AS size, (SELECT count(*) FROM kc WHERE cache_key IN (SELECT cache_key FROM ca)) AS hits, (SELECT count(*) FROM kc) AS reads, (SELECT count(*) FROM kc WHERE (file_id + chunk_index) % 3 = 0 AND file_id % 48 >= 24) AS evictions) SELECT *, printf('ChunkCache[size=%d, hitRate=%.2f%%, evictions=%d]', size, hits / reads * 100, evictions) AS stats FROM x",
        "chunk_states": f"WITH {KEYED} SELECT kc.*, CASE WHEN ca.cache_key IS NOT NULL THEN 'DONE' WHEN (kc.file_id + 2 * kc.chunk_index) % 7 = 0 THEN 'FAILED' ELSE 'PENDING' END AS state FROM kc LEFT JOIN (SELECT DISTINCT cache_key FROM ca) ca USING (cache_key)",
        "partial_results": f"WITH {KEYED}, st AS (SELECT kc.*, ca.cache_key IS NOT NULL AS done, ca.cache_key IS NULL AND (kc.file_id + 2 * kc.chunk_index) % 7 = 0 AS failed FROM kc LEFT JOIN (SELECT DISTINCT cache_key FROM ca) ca USING (cache_key)) SELECT file_id, count(*) AS total, count(*) FILTER (done) AS done, count(*) FILTER (failed) AS failed, bool_and(done) AS complete FROM st GROUP BY file_id",
        "job_after_delete": "WITH s AS (SELECT user_id AS job_id, arg_max(event_id, {'t': ts, 'i': event_id}) AS seq, arg_max(event_type, {'t': ts, 'i': event_id}) AS status, max({'t': ts, 'i': event_id}) AS last FROM events WHERE event_type <> 'click' GROUP BY 1), d AS (SELECT user_id AS job_id, max({'t': ts, 'i': event_id}) AS gone FROM events WHERE event_type = 'click' GROUP BY 1) SELECT job_id, seq, status FROM s LEFT JOIN d USING (job_id) WHERE gone IS NULL OR last > gone",
        "first_language": f"WITH {TURNS} SELECT file_id, coalesce(arg_min(language, seq), 'en') AS language FROM tn GROUP BY file_id",
        "output_keys": r"SELECT page_id, regexp_replace(url, '\.[^.]+$', '.json') AS json_key, regexp_replace(url, '\.[^.]+$', '.srt') AS srt_key, regexp_replace(url, '\.[^.]+$', '.json') = url OR regexp_replace(url, '\.[^.]+$', '.srt') = url AS clash, regexp_replace(url, '\.[^.]+$', '') || '_transcript.json' AS json_name, regexp_replace(url, '\.[^.]+$', '') || '_transcript.srt' AS srt_name FROM pages",
        "cache_hits": f"WITH {KEYED} SELECT * FROM kc WHERE cache_key IN (SELECT cache_key FROM ca)",
        "cache_misses": f"WITH {KEYED} SELECT * FROM kc WHERE cache_key NOT IN (SELECT cache_key FROM ca)",
        "cache_evict_file": f"WITH {KEYED} SELECT cache_key, file_id, chunk_index FROM ca WHERE NOT starts_with(cache_key, 'audio:3:')",
        "cache_evict_key": f"WITH {KEYED} SELECT cache_key, file_id, chunk_index FROM ca WHERE chunk_index <> 0",
        "cache_hit_rate": f"WITH {KEYED} SELECT count(*) AS n, count(ca.cache_key) AS hits, count(ca.cache_key) / count(*) AS rate FROM kc LEFT JOIN ca USING (cache_key)",
        "job_latest_status": f"WITH {JOBS} SELECT job_id, seq, status, CAST(CASE status WHEN 'PENDING' THEN 0 WHEN 'COMPLETED' THEN 100 ELSE 10 END AS BIGINT) AS progress, CASE WHEN status = 'FAILED' THEN event_type END AS error FROM la",
        "job_live": f"WITH {JOBS} SELECT job_id, seq, status FROM la WHERE ts > (SELECT max(ts) FROM jl) - INTERVAL 60 MINUTE",
        "retention_topk": f"WITH {JOBS} SELECT job_id, seq, status FROM jl ORDER BY ts DESC, seq DESC LIMIT 1000",
        "concat_merge": f"WITH {FILES}, {SEGMENTS}, {_chunks(0)}, {PLAIN_CS} SELECT file_id, chunk_index, seg_idx, start_time + start_s AS start_s, start_time + end_s AS end_s, text, coalesce(lag(start_time + end_s) OVER (PARTITION BY file_id ORDER BY chunk_index, seg_idx) > start_time + start_s, false) AS overlaps FROM pcs JOIN ch USING (file_id, chunk_index)",
        "segment_aggregate": f"WITH {BASE} SELECT file_id, chunk_index, min(start_s) AS start_s, max(end_s) AS end_s, count(*) AS n_segments, string_agg(text, ' ' ORDER BY seg_idx) AS text FROM cs GROUP BY file_id, chunk_index",
        "chunk_preview": f"WITH {FILES}, {CHUNKS} SELECT *, CAST(floor(greatest(start_time - 1, 0) * 16384) AS BIGINT) AS first_byte, CAST(ceil((end_time + 1) * 16384) AS BIGINT) AS last_byte FROM ch",
    }
