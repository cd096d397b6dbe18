"""Requests, objects, deletes, plans and the older merge's order of arguments."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

import rules
from spanloom import queries
from spanloom.operators import legacy, match, merge
from spanloom.plans import request
from spanloom.sources import objects, state, writers
from spanloom.staging import new_path
from test_timed_text import CH, SEG, random_files, tables

SF = "/root/testdata/sf0.001"
has_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def test_request_defaults_and_limits():
    r = request.Request("b", "k")
    assert (r.chunk_seconds, r.min_overlap_seconds, r.save) == (3600, 30, True)
    assert request.Request("b", "k", 10, 120, False).save is False
    for wrong in [("", "k"), ("b", " \t"), ("b", None), ("b", "k", 9), ("b", "k", 3601), ("b", "k", 60, 29), ("b", "k", 60, 121)]:
        with pytest.raises(ValueError):
            request.Request(*wrong)


def test_requests_as_a_table(spark):
    rows = [("b", "k", None, None, None), (" ", None, 9, 121, False), ("b", "k", 10, 30, True)]
    got = request.checked(spark.createDataFrame(rows, "bucket string, key string, chunk_seconds int, min_overlap_seconds int, save boolean")).collect()
    assert [(r["chunk_seconds"], r["min_overlap_seconds"], r["save"], r["wrong"]) for r in got] == [(3600, 30, True, []), (9, 121, False, ["bucket", "key", "chunk_seconds", "min_overlap_seconds"]), (10, 30, True, [])]


def test_older_merge_compares_the_kept_segment_to_the_new_one(spark):
    """The similarity of "a a" to "a" is 2, that of "a" to "a a" one half."""
    segs, chunks = tables(spark, [[(0.0, 10.0, [(0, 2, "a a"), (0.5, 2.5, "a")])], [(0.0, 10.0, [(0, 2, "a"), (0.5, 2.5, "a a")])]])
    got = legacy.dedup_merge(segs, chunks).orderBy("file_id", "seg_idx").collect()
    assert [(r["file_id"], r["text"]) for r in got] == [(0, "a a"), (1, "a"), (1, "a a")]
    counts = legacy.removed(segs, chunks).orderBy("file_id").collect()
    assert [tuple(r) for r in counts] == [(0, 0, 1, 1), (1, 0, 0, 0)]


def test_removed_characters_are_utf16_units(spark):
    segs, chunks = tables(spark, [[(0.0, 10.0, [(0, 2, "😀 é"), (0.5, 2.5, "😀 é")])]])
    assert tuple(legacy.removed(segs, chunks).first()) == (0, 0, 1, 4)


def test_objects_have_their_names_and_refuse_a_clash(spark):
    root = new_path(spark, "objects")
    docs = spark.createDataFrame([("x/y.mp3", "é1"), ("a b.wav", ""), ("z.mp3", None)], "source string, body string")
    named = writers.output_keys(docs, "source").withColumnRenamed("json_key", "key")
    got = writers.write_objects(named, root)
    assert sorted((r["key"], r["length"]) for r in got.collect()) == [("a b.json", 0), ("x/y.json", 3), ("z.json", 0)]
    assert sorted(r["length"] for r in objects.heads(spark, f"{root}/x").collect()) == [3]
    with open(f"{root.removeprefix('file://')}/x/y.json", encoding="utf-8") as f:
        assert f.read() == "é1"
    again = writers.write_objects(named.withColumn("body", F.lit("new")), root)
    assert {r["length"] for r in again.collect()} == {3}
    clash = writers.output_keys(spark.createDataFrame([("noext", "x")], "source string, body string"), "source").withColumnRenamed("json_key", "key")
    with pytest.raises(Exception, match="overwrite"):
        writers.write_objects(clash, root)
    with pytest.raises(Exception, match="overwrite"):
        writers.write_documents(clash.withColumn("file_id", F.lit(1)), "body", root + "/d")


def test_ranges_read_only_what_is_asked_for(spark, tmp_path):
    (tmp_path / "o.bin").write_bytes(bytes(range(20)))
    at = f"file://{tmp_path}/o.bin"
    wanted = spark.createDataFrame([(at, 3, 5), (at, 18, 30), (at, 20, 25), (at, 50, 60)], "path string, first long, last long")
    assert [bytes(r["content"]) for r in objects.ranges(wanted).orderBy("first").collect()] == [bytes([3, 4, 5]), bytes([18, 19]), b"", b""]


def test_deletes_and_statistics(spark):
    from datetime import datetime

    d = lambda h: datetime(2024, 1, 1, h)
    log = spark.createDataFrame([(1, 1, d(1), "a"), (1, 2, d(3), "b"), (2, 3, d(1), "c"), (3, 4, d(5), "d")], "job_id long, seq long, ts timestamp, s string")
    gone = spark.createDataFrame([(1, 9, d(2)), (2, 9, d(2))], "job_id long, seq long, ts timestamp")
    assert sorted(r["job_id"] for r in state.after_deletes(log, gone).collect()) == [1, 3]
    assert state.after_deletes(log, gone.limit(0)).count() == 3
    versions = spark.createDataFrame([("k1", d(1)), ("k1", d(20)), ("k2", d(2))], "cache_key string, at timestamp")
    reads = spark.createDataFrame([(True,), (False,)], "hit boolean")
    r = state.cache_stats(versions, "cache_key", "at", F.lit(datetime(2024, 1, 2, 10)), reads).first()
    assert (r["size"], r["hits"], r["reads"], r["evictions"], r["stats"]) == (1, 1, 2, 1, "ChunkCache[size=1, hitRate=50.00%, evictions=1]")


def test_time_after_the_nth_word(spark):
    files = random_files(5, 40)
    segs, _ = tables(spark, files)
    for n in (1, 4, 50):
        got = {(r["file_id"], r["chunk_index"]): r["at"] for r in merge.after_word(segs, F.lit(n)).collect()}
        for f, chunks in enumerate(files):
            for c, (_, _, ss) in enumerate(chunks):
                count, want = 0, None
                for _, e, t in ss:
                    count += rules.trimmed_count(t)
                    if count >= n:
                        want = e
                        break
                if ss:
                    assert got[f, c] == (ss[-1][1] if want is None else want)
                else:
                    assert (f, c) not in got


def test_longest_match_of_chunks_equals_the_rule(spark):
    files = random_files(6, 240)
    segs, chunks = tables(spark, files)
    got = {(r["file_id"], r["chunk_index"]): (r["match_length"], r["text1_end"], r["text2_start"], r["matched"]) for r in match.longest_match(segs, chunks).collect()}
    seen = 0
    for f, cs in enumerate(files):
        for c in range(1, len(cs)):
            a = [w for s, _, t in cs[c - 1][2] if s >= cs[c][0] - cs[c - 1][0] for w in rules.words(t)]
            b = [w for _, _, t in cs[c][2] for w in rules.words(t)]
            n, end, at = rules.longest(a, b)
            assert got.get((f, c), (0, 0, 0, []))[:3] == (n, end, at)
            assert not n or got[f, c][3] == a[end - n : end]
            seen += n > 0
    assert seen > 5


@has_tables
def test_the_varied_table_has_every_branch(spark):
    branches = {r["branch"] for r in queries.merge_branches(spark, SF).select("branch").distinct().collect()}
    assert branches == {"first", "prev_empty", "cur_empty", "no_overlap", "timestamp", "match"}


@has_tables
@pytest.mark.parametrize("name, scans, exchanges", [("merge_transcript", 2, 3), ("merge_pairwise", 2, 3), ("longest_match", 2, 3)])
def test_merges_read_and_shuffle_once(spark, name, scans, exchanges):
    plan = queries.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("FileScan", plan)) <= scans and len(re.findall(r"\bExchange ", plan)) <= exchanges


def test_chunks_without_segments(spark):
    rng = random.Random(1)
    segs = spark.createDataFrame([], SEG)
    chunks = spark.createDataFrame([(1, i, i * 5.0, i * 5.0 + rng.randint(6, 9)) for i in range(3)], CH)
    assert merge.merge_transcripts(segs, chunks).count() == 0 and match.longest_match(segs, chunks).count() == 0
    assert {r["branch"] for r in merge.decisions(segs, chunks).collect()} == {"first", "prev_empty"}
