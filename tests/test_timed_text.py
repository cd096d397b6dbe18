import random

import pytest
from pyspark.sql import functions as F

import rules
from spanloom.functions import text as T
from spanloom.functions import times
from spanloom.operators import legacy, match, merge
from spanloom.plans import chunking, timeline
from spanloom.sources import objects, state, writers

SEG = "file_id long, chunk_index long, seg_idx long, start_s double, end_s double, text string"
CH = "file_id long, chunk_index long, start_time double, end_time double"


def tables(spark, files):
    """files: list of chunk lists (start, end, [(start, end, text)])."""
    segs = [(f, c, i, float(s), float(e), t) for f, chunks in enumerate(files) for c, (_, _, ss) in enumerate(chunks) for i, (s, e, t) in enumerate(ss)]
    chunks = [(f, c, float(a), float(b)) for f, cs in enumerate(files) for c, (a, b, _) in enumerate(cs)]
    return spark.createDataFrame(segs, SEG), spark.createDataFrame(chunks, CH)


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "t string").select(*columns).first()


@pytest.mark.parametrize("text, trimmed, untrimmed", [("", 1, 1), ("  ", 1, 0), (" a b ", 2, 3), ("a b ", 2, 2), ("\ta\x0bb\n", 2, 3)])
def test_counts(spark, text, trimmed, untrimmed):
    r = one(spark, text, T.count_trimmed(F.col("t")), T.count_untrimmed(F.col("t")), F.size(T.words(F.col("t"))))
    assert tuple(r) == (trimmed, untrimmed, len(rules.words(text)))


def test_words_and_normalisation(spark):
    assert one(spark, "Hello world, this is a test!", T.words(F.col("t")))[0] == ["Hello", "world,", "this", "is", "a", "test!"]
    assert one(spark, "Hello    world   test", T.words(F.col("t")))[0] == ["Hello", "world", "test"]
    for w in ["Hello,", "e-mail", "“hi”", "(x)", "...", "It's", "ÜBER!"]:
        assert one(spark, w, T.normalize(F.col("t")))[0] == rules.norm(w)


@pytest.mark.parametrize("a, b", [("a a", "a"), ("a", "a a"), ("", ""), ("x y z", "z y"), (" a", "a")])
def test_jaccard(spark, a, b):
    r = spark.createDataFrame([(a, b)], "a string, b string").select(T.jaccard(F.col("a"), F.col("b"))).first()[0]
    assert r == pytest.approx(rules.jaccard(a, b))
    assert legacy.word_overlap(rules.pieces(a), rules.pieces(b)) == pytest.approx(r)


@pytest.mark.parametrize("s, code", [(0.0, "00:00:00,000"), (5.2, "00:00:05,200"), (3661.5, "01:01:01,500"), (4.35, "00:00:04,349"), (90000.0, "25:00:00,000")])
def test_timecode(spark, s, code):
    assert spark.range(1).select(times.timecode(F.lit(s))).first()[0] == code


def test_keys(spark):
    rows = spark.createDataFrame([("x/y.mp3",), ("a.v1/b",), ("noext",)], "key string")
    got = writers.output_keys(rows, "key").select("json_key", "srt_key", "clash", times.transcript_name(F.col("key"), ".json")).collect()
    assert [tuple(r) for r in got] == [("x/y.json", "x/y.srt", False, "x/y_transcript.json"), ("a.json", "a.srt", False, "a_transcript.json"), ("noext", "noext", True, "noext_transcript.json")]


RUNS = [
    ("the quick brown fox", "brown fox jumps over", 2, (2, 4, 0)),
    ("hello world this is a test", "some words this is a test here", 3, (4, 6, 2)),
    ("the cat sat on the mat", "the dog sat on the mat too", 2, (4, 6, 2)),
    ("Hello World", "hello world again", 2, (2, 2, 0)),
    ("hello world.", "hello world again", 2, (2, 2, 0)),
    ("completely different words", "nothing in common", 2, None),
    ("the cat", "the dog", 3, None),
    ("", "some words", 2, None),
    ("and that's why we need to focus on the customer experience because at the end of the day", "because at the end of the day it's all about delivering value", 3, (7, 18, 0)),
    ("hello, world!", "hello world", 2, (2, 2, 0)),
    ("a b c x a b c", "a b c y a b c", 3, (3, 3, 0)),
    ("... !! ??", ", ; :", 3, (3, 3, 0)),
]


def runs(spark, pairs, least):
    rows = [(k, side, 0, t) for k, ab in enumerate(pairs) for side, t in enumerate(ab)]
    df = spark.createDataFrame(rows, "pair long, side int, seg_idx long, text string")
    a, b = (match.word_rows(df.where(F.col("side") == side).drop("side"), ["pair"]) for side in (0, 1))
    return {r["pair"]: (r["match_length"], r["text1_end"], r["text2_start"]) for r in match.longest_runs(a, b, ["pair"], least).collect()}


@pytest.mark.parametrize("least", [2, 3])
def test_literal_runs(spark, least):
    cases = [(a, b, want) for a, b, n, want in RUNS if n == least]
    got = runs(spark, [c[:2] for c in cases], least)
    assert [got.get(i) for i in range(len(cases))] == [c[2] for c in cases]


def test_matched_words_are_the_original_ones(spark):
    df = spark.createDataFrame([(0, 0, "say Hello, World! now")], "pair long, seg_idx long, text string")
    other = spark.createDataFrame([(0, 0, "hello world now")], "pair long, seg_idx long, text string")
    a, b = match.word_rows(df, ["pair"]), match.word_rows(other, ["pair"])
    assert match.matched_words(match.longest_runs(a, b, ["pair"], 3), a, ["pair"]).first()["matched"] == ["Hello,", "World!", "now"]


def test_random_runs_equal_the_loop(spark):
    rng = random.Random(1)
    pairs = [tuple(" ".join(rng.choice("abc") for _ in range(rng.randint(0, 14))) for _ in range(2)) for _ in range(150)]
    got = runs(spark, pairs, 3)
    for k, (a, b) in enumerate(pairs):
        assert got.get(k, (0, 0, 0)) == rules.longest(a.split(), b.split())


LITERAL = [
    [(0, 300, [(289.05, 295.05, "And I just get them all to agree. And if they do, but in after I've said that, I can let them say the thing, okay, thanks Stephen."), (295.05, 300.05, "I'm still sharing the idea. I'll come back to your question in a moment. And you have to reclaim your land.")]),
     (268.41, 568.41, [(0, 2.48, "thanks Stephen"), (2.48, 4.2, "I'm still sharing the idea."), (4.2, 5.92, "I'll come back to your question in a moment."), (5.92, 7.72, "And you have to reclaim your land."), (7.72, 10, "This is new content that should appear."), (10, 12.5, "And this is also new content.")])],
    [(0, 100, [(0, 5, "First chunk content")]), (100, 200, [(0, 5, "Second chunk content")])],
    [(0, 100, [(90, 100, "the quick brown fox jumps over")]), (80, 180, [(10, 20, "the quick brown fox jumps over"), (20, 25, "the lazy dog")])],
    [(0, 100, []), (100, 200, [(0, 5, "Content")])],
    [(0, 100, [(0, 5, "Content")]), (100, 200, [])],
    [(0, 100, [(90, 95, "a b c")]), (90, 190, [(0, 5, "a b c"), (5, 6, ""), (6, 9, "d e")])],
    [(0, 100, [(90, 95, "x y z")]), (90, 190, [(0, 4, "p q r"), (4, 6, "s t"), (5, 9, "u v")])],
]


def test_literal_merges_and_branches(spark):
    segs, chunks = tables(spark, LITERAL)
    got = {}
    for r in merge.merge_pairs(segs, chunks).where("chunk_index = 1").orderBy("file_id", "seg_idx").collect():
        got.setdefault(r["file_id"], []).append((round(r["start_s"], 6), r["text"]))
    branches = {r["file_id"]: r["branch"] for r in merge.decisions(segs, chunks).where("chunk_index = 1").collect()}
    for k, (prev, cur) in enumerate(LITERAL):
        branch, want = rules.merge(prev, cur)
        assert branches[k] == branch
        assert got.get(k, []) == [(round(s, 6), t) for s, _, t in want]
    assert got[0] == [(276.13, "This is new content that should appear."), (278.41, "And this is also new content.")]
    assert got[5] == [(95.0, ""), (96.0, "d e")]
    assert set(branches.values()) == {"match", "no_overlap", "prev_empty", "cur_empty", "timestamp"}


def random_files(seed, n):
    rng = random.Random(seed)
    files = []
    for _ in range(n):
        chunks, at = [], 0.0
        for _ in range(rng.randint(1, 5)):
            segs, t = [], 0.0
            for _ in range(rng.choice([0, 1, 3, 6])):
                d = rng.choice([0.5, 1.0, 2.0])
                segs.append((t, t + d, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 4)))))
                t += rng.choice([0.0, d, d, 1.5])
            chunks.append((at, at + 8.0, segs))
            at += rng.choice([2.0, 5.0, 6.0])
        files.append(chunks)
    return files


def test_random_files_equal_the_fold(spark):
    files = random_files(2, 120)
    segs, chunks = tables(spark, files)
    got = {}
    for r in merge.merge_transcripts(segs, chunks).orderBy("file_id", "seq").collect():
        got.setdefault(r["file_id"], []).append((r["start_s"], r["end_s"], r["text"]))
    for k, f in enumerate(files):
        assert got.get(k, []) == rules.fold(f)


def test_random_files_equal_the_older_merge(spark):
    files = random_files(3, 120)
    segs, chunks = tables(spark, files)
    got = {}
    for r in legacy.dedup_merge(segs, chunks).orderBy("file_id", "chunk_index", "seg_idx").collect():
        got.setdefault(r["file_id"], []).append((r["start_s"], r["end_s"], r["text"]))
    for k, f in enumerate(files):
        assert got.get(k, []) == rules.legacy(f)


def dense(total):
    return [(float(s), s + 5.0, 5) for s in range(0, total, 5)]


def test_planner_rules():
    assert [s for s, _ in chunking.plan_file(600, dense(600), 300, 30, "compat")] == [0, 270, 510]
    assert [s for s, _ in chunking.plan_file(600, dense(600), 300, 30, "fixed")] == [0, 270, 540]
    for total, chunk in [(300, 60), (100, 10)]:
        with pytest.raises(ValueError):
            list(chunking.plan_file(total, dense(total), chunk, 30, "compat"))
    assert list(chunking.plan_file(0, [], 60, 30, "compat")) == []


def test_planners_on_tables(spark):
    files = spark.createDataFrame([(0, 600), (1, 0), (2, 50), (3, 300)], "file_id long, duration_s long")
    got = [(r["file_id"], r["start_time"], r["end_time"]) for r in chunking.fixed(files, 120, 30).orderBy("file_id", "chunk_index").collect()]
    want = [(f, i * 90.0, min(i * 90.0 + 120, t)) for f, t in [(0, 600), (1, 0), (2, 50), (3, 300)] for i in range(chunking.count_fixed(t, 120, 30))]
    assert got == want and all(e == t for f, t in [(0, 600), (2, 50), (3, 300)] for g, _, e in [max(x for x in got if x[0] == f)])
    rows = [(f, i, s, e, "a b c d e") for f, t in [(0, 600), (3, 300)] for i, (s, e, _) in enumerate(dense(t))]
    segs = spark.createDataFrame(rows, "file_id long, seg_idx long, start_s double, end_s double, text string")
    got = [(r["file_id"], r["start_time"]) for r in chunking.dynamic(files, segs, 300, 30).orderBy("file_id", "chunk_index").collect()]
    assert got == [(0, 0), (0, 270), (0, 510), (2, 0), (3, 0)]
    gap = spark.createDataFrame([(3, 0, 0.0, 100.0, "a"), (3, 1, 104.0, 150.0, "b"), (3, 2, 152.0, 300.0, "c")], segs.schema)
    got = [(r["start_time"], r["end_time"]) for r in chunking.at_silences(files.where("file_id = 3"), gap, 160, 100).orderBy("chunk_index").collect()]
    assert got == [(0, 102), (102, 262), (262, 300)]


def test_long_files_are_refused(spark):
    files = spark.createDataFrame([(0, 24 * 3600 + 3599), (1, 25 * 3600)], "file_id long, duration_s long")
    assert timeline.within_limit(files.where("file_id = 0")).count() == 1
    with pytest.raises(Exception, match="more than the limit"):
        timeline.within_limit(files).collect()


def test_interval_slices(spark):
    rng = random.Random(5)
    segs = [(f, i, float(s := i * 3 + rng.random()), s + 2.0, "x") for f in range(3) for i in range(60)]
    chunks = [(f, c, c * 37.0, c * 37.0 + 50) for f in range(3) for c in range(5)]
    got = timeline.slice_by_chunks(spark.createDataFrame(segs, "file_id long, seg_idx long, start_s double, end_s double, text string"), spark.createDataFrame(chunks, CH), 20.0)
    want = sorted((f, c, i, s - a, e - a) for f, c, a, b in chunks for g, i, s, e, _ in segs if f == g and a <= s < b)
    assert sorted((r["file_id"], r["chunk_index"], r["seg_idx"], r["start_s"], r["end_s"]) for r in got.collect()) == want


def test_writers(spark, tmp_path):
    import json

    merged = spark.createDataFrame([(1, 0, 0.0, 5.2, "Hello"), (1, 1, 5.2, 10.5, "world")], "file_id long, seq long, start_s double, end_s double, text string")
    srt = writers.srt_documents(merged)
    assert srt.first()["srt"] == "1\n00:00:00,000 --> 00:00:05,200\nHello\n\n2\n00:00:05,200 --> 00:00:10,500\nworld\n\n"
    languages = spark.createDataFrame([(1, "de"), (2, "en")], "file_id long, language string")
    docs = {r["file_id"]: json.loads(r["json"]) for r in writers.json_documents(merged, languages).collect()}
    assert docs[1] == {"language": "de", "segments": [{"start": 0.0, "end": 5.2, "text": "Hello"}, {"start": 5.2, "end": 10.5, "text": "world"}]}
    assert docs[2] == {"language": "en", "segments": []}
    writers.write_documents(srt, "srt", str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).where("value = 'Hello'").count() == 1
    assert writers.srt_documents(merged.limit(0)).count() == 0


def test_objects_and_recogniser(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(bytes(range(20)))
    assert objects.heads(spark, str(tmp_path)).first()["length"] == 20
    assert bytes(objects.contents(spark, str(tmp_path)).select(objects.byte_range(F.col("content"), 3, 5)).first()[0]) == bytes([3, 4, 5])
    body = '{"segments":[{"start":0.0,"end":1.5,"text":"hi"}],"language":"en"}'
    rows = objects.parsed(spark.createDataFrame([(1, 0, body)], "file_id long, chunk_index long, body string")).collect()
    assert [tuple(r) for r in rows] == [(1, 0, 0, 0.0, 1.5, "hi")]

    class Fake:
        failed = False

        def transcribe(self, file_id, chunk_index, start, end):
            if not self.failed:
                self.failed = True
                raise OSError("try again")
            return [(0.0, end - start, f"file {file_id} chunk {chunk_index}")]

    chunks = spark.createDataFrame([(1, 0, 0.0, 60.0), (1, 1, 30.0, 90.0)], CH)
    got = objects.transcribe(chunks, Fake(), pause_s=0.0).orderBy("chunk_index").collect()
    assert [(r["end_s"], r["text"]) for r in got] == [(60.0, "file 1 chunk 0"), (60.0, "file 1 chunk 1")]


def test_cache_and_jobs(spark):
    from datetime import datetime as d

    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    cache = spark.createDataFrame([("a:1:x", d(2024, 1, 1, 12)), ("a:1:x", d(2023, 12, 1)), ("a:2:x", d(2023, 12, 31)), ("a:12:x", d(2024, 1, 1, 1))], "cache_key string, written_at timestamp")
    live = state.live(cache, "cache_key", "written_at", now, state.CACHE_TTL_S)
    assert {r[0] for r in live.select("cache_key").collect()} == {"a:1:x", "a:12:x"}
    wanted = spark.createDataFrame([("a:1:x",), ("a:2:x",)], "cache_key string")
    assert [r[0] for r in state.hits(wanted, live).collect()] == ["a:1:x"] and [r[0] for r in state.misses(wanted, live).collect()] == ["a:2:x"]
    assert {r[0] for r in state.without_file(live, "a:1:").select("cache_key").collect()} == {"a:12:x"}
    assert tuple(state.hit_rate(spark.createDataFrame([(True,), (False,)], "hit boolean")).first()) == (2, 1, 0.5)
    log = spark.createDataFrame([(1, 1, d(2024, 1, 1), "PENDING"), (1, 2, d(2024, 1, 1), "FAILED"), (2, 3, d(2024, 1, 1), "COMPLETED")], "job_id long, seq long, ts timestamp, s string")
    got = state.job_status(log.select("job_id", "seq", "ts", *state.job_event(F.col("s"), F.lit("broken")))).orderBy("job_id").collect()
    assert [(r["status"], r["progress"], r["error"]) for r in got] == [("FAILED", 10, "broken"), ("COMPLETED", 100, None)]
    assert [r["seq"] for r in state.newest(log, "ts", "seq", 2).collect()] == [3, 2]


def test_stream_equals_batch(spark, tmp_path):
    from datetime import datetime as d
    from datetime import timedelta

    from spanloom.streaming.jobs import latest_status

    rng = random.Random(7)
    rows = [(rng.randrange(5), i, d(2024, 1, 1) + timedelta(seconds=rng.randrange(300)), rng.choice(state.STATUSES)) for i in range(60)]
    schema = "job_id long, seq long, ts timestamp, status string"
    for k in range(3):
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = latest_status(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("update").format("memory").queryName("jobs").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    seen = {}
    for r in spark.table("jobs").collect():
        if not r["expired"]:
            seen[r["job_id"]] = max(seen.get(r["job_id"], (d.min, -1)), (r["ts"], r["seq"]))
    want = {r["job_id"]: (r["ts"], r["seq"]) for r in state.job_status(spark.createDataFrame(rows, schema)).collect()}
    assert seen == want


def test_optional_plans(spark):
    segs, chunks = tables(spark, [[(0, 10, [(0, 4, "a"), (4, 8, "b")]), (10, 20, [(0, 5, "c")])]])
    rows = timeline.concatenated(segs, chunks).orderBy("chunk_index", "seg_idx").collect()
    assert [(r["start_s"], r["overlaps"]) for r in rows] == [(0, False), (4, False), (10, False)]
    got = timeline.aggregated(segs).orderBy("chunk_index").first()
    assert (got["start_s"], got["end_s"], got["n_segments"], got["text"]) == (0, 8, 2, "a b")
    assert timeline.first_language(chunks.withColumn("language", F.lit(None).cast("string"))).first()["language"] == "en"
