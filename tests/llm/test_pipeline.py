"""The pipeline's stages, each on what the one before kept, against plain versions."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"xx": ["kala", "mira", "tolo", "vene", "suri", "hapo"], "yy": ["brecht", "stump", "flink", "grond", "schaft", "dorn"]}


def corpus():
    rng = random.Random(1)

    def text(lang, n):
        return " ".join("".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))

    items = [(i, text("xx", 15)) for i in range(3)]
    rows = []
    for i in range(150):
        lang = rng.choice(list(WORDS))
        rows.append([text(lang, rng.choice([8, 40, 90])), lang])
    for i in range(15):
        rows.append([rows[i][0], rows[i][1]])
    for i in range(15, 25):
        w = rows[i][0].split()
        w[len(w) // 2] = "changed"
        rows.append([" ".join(w), rows[i][1]])
    for i in range(8):
        rows.append([text("xx", 20) + " " + items[i % 3][1].upper() + ", " + text("xx", 20), "xx"])
    rows += [[None, "xx"], ["123 ...", "xx"], ["", None]]
    rng.shuffle(rows)
    docs = [(i, t, g, rng.choice(["a", "b", "c", None]), len(t or "")) for i, (t, g) in enumerate(rows)]
    return docs + [docs[0]], items


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    docs, items = corpus()
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, DOC).withColumn("extra", F.lit(1)).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, docs, items


def test_stages(spark, tables):
    at, docs, items = tables
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    df = spark.read.parquet(f"{at}/documents.parquet")
    kept = [r for r in docs if any(c.isalpha() for c in r[1] or "")]
    steps = list(stages.values())

    df = steps[0](spark, df, at)
    assert df.columns == corpus_pipeline.COLUMNS and sorted(map(tuple, df.collect()), key=repr) == sorted(kept, key=repr)

    pairs = sorted({(r[0], r[1]) for r in kept})
    first = {pairs[c][0] for c in brute.near_classes(pairs)}
    df = steps[1](spark, df, at)
    assert df.columns == corpus_pipeline.COLUMNS and sorted(r["doc_id"] for r in df.collect()) == sorted(first)

    rest = [p for p in pairs if p[0] in first]
    clean = {d for (d, _), (_, hit, _) in zip(rest, brute.contamination(rest, items)) if not hit}
    df = steps[2](spark, df, at)
    assert df.columns == corpus_pipeline.COLUMNS and {r["doc_id"] for r in df.collect()} == clean and len(clean) < len(rest)

    by = {r[0]: r for r in docs}
    targets = brute.mix_targets([(by[d][3], len(by[d][1].split())) for d in clean])
    df = steps[3](spark, df, at)
    copies = Counter(r["doc_id"] for r in df.collect())
    assert df.columns == corpus_pipeline.COLUMNS and set(copies) <= clean and max(copies.values()) <= 2
    for s, t in targets.items():
        taken = sum(n * len(by[d][1].split()) for d, n in copies.items() if by[d][3] == s)
        assert abs(taken - t) <= 0.02 * t + 10

    out = steps[4](spark, df, at)
    assert Counter(r["doc_id"] for r in out.collect()) == copies


def test_run_equals_the_stages(spark, tables):
    at = tables[0]
    a, b = (sorted(map(tuple, corpus_pipeline.run(spark, at).collect())) for _ in range(2))
    assert a == b and len(a) > 100


def test_pipeline_of_nothing(spark, tables, tmp_path):
    at = tables[0]
    spark.read.parquet(f"{at}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{at}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered_queries_have_the_contract_columns(spark):
    import __spark_entry__

    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in __spark_entry__.queries()
