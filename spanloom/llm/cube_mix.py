"""Operator 5: mixing sources to target weights by the cube method.

Sources in code-point order, null last, get the weights 5, 2, 1, repeating. They share ``share`` times all words; a target stops at
``most`` times its source's words, and what is over goes to the others by weight. A source that takes r times its words takes
every document floor(r) times, and once more with probability f = r - floor(r). These last draws are balanced on the documents'
sizes and on their number.

Flight: up to ``WINDOW`` undecided documents are open at a time, the largest first. Each step moves their probabilities along the null space of the two
constraints, in the direction that moves the largest document most, forwards or backwards at odds that keep every expectation, until one of
them is 0 or 1. So large documents are settled against many small ones, and what stays open is small. Chunks of a source fly apart from each other,
one pass of a stream each, and leave at most two open documents; those of ``FAN`` chunks fly together on the next level, until a source is one chunk.
Landing: the two that stay open then give up the constraint on their number, and the very last one is drawn by its probability. Every document's
probability of its extra copy is f exactly.

Only where a document is so large that one outcome of its draw would leave its source's words more than ``near`` off the target, whatever is drawn of all others
together, is it not drawn: such documents, of which a source has few (their number is bounded by 1 / f and 1 / (1 - f)), are rounded first, the largest first, each to
the outcome nearer to the target, and the other documents' probabilities are shifted evenly by the words that this adds or lacks.

Draws come from generators seeded by ``seed``, level and chunk, and chunks from hashes of the rows, so reruns agree whatever the layout.

Rows: a null text has size 0, and rows of size 0 take 0 words; a null source is a source; repeated rows are separate documents (identical ones may
differ in ``taken``, as a whole they agree between runs); very long texts are documents as others; an empty table gives no row. Columns of :func:`plan_mix`'s
result replace those of the same name. Sources' targets are worked out over a row per source, in one task.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.staging import staged

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
#: Rows of a chunk about, open units of a flight at most, and chunks whose open units meet in a chunk of the next level.
CHUNK_ROWS, WINDOW, FAN = 4096, 512, 2048


def word_count(text: Column) -> Column:
    """Number of runs without ASCII white space: starts of such runs are counted on a copy with one kind of space and one kind of other."""
    spaces = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.size(F.filter(F.split(spaces, " +"), lambda w: w != "")), F.lit(0)).cast("long")


def text_hash() -> Column:
    """A hash of ``text`` that tells null from empty."""
    return F.xxhash64("text", F.col("text").isNull())


def targets_of(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from rows (source, size): water-filling in closed form over the sources in order of cap by weight."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    s = sums.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * float(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    s = s.withColumn("level", level).withColumn("open", F.col("level") <= F.col("cap") / F.col("weight"))
    final = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(everything)["level"]
    target = F.when(final.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), final * F.col("weight")))
    return s.select("source", "source_size", "n_docs", target.alias("target"))


class Flight:
    """Streaming cube flight of one group: units (p, size, tag) go in, decided ones (tag, 0 or 1) come out; at most two stay open at the end."""

    def __init__(self, rng: random.Random, window: int = WINDOW):
        self.rng, self.window = rng, window
        self.p, self.size, self.tags = np.zeros(0), np.zeros(0), []

    def add(self, p: float, size: int, tag) -> list[tuple]:
        if p <= 0 or p >= 1:
            return [(tag, int(p >= 1))]
        self.p, self.size = np.append(self.p, p), np.append(self.size, float(size))
        self.tags.append(tag)
        return self.step() if len(self.tags) > self.window else []

    def direction(self) -> np.ndarray | None:
        """Of the moves that keep words and documents, that nearest to raising the largest unit that can move alone; None if there is no move."""
        n = len(self.tags)
        c = self.size - self.size.mean() if n else self.size
        spread = float(c @ c)
        c = c / spread**0.5 if spread > 1e-9 else c * 0
        able = 1 - 1 / max(1, n) - c * c > 1e-9
        if not able.any():
            return None
        i = int(np.argmax(np.where(able, self.size, -1.0)))
        v = -1 / n - c * c[i]
        v[i] += 1
        return np.where(np.abs(v) > 1e-12, v, 0.0)

    def move(self, v: np.ndarray) -> list[tuple]:
        """One random step along v, to where a probability is 0 or 1, that keeps all expectations."""
        moves = v != 0
        room_up = np.where(v > 0, 1 - self.p, self.p)[moves] / np.abs(v[moves])
        room_down = np.where(v > 0, self.p, 1 - self.p)[moves] / np.abs(v[moves])
        up, down = room_up.min(), room_down.min()
        is_up = self.rng.random() * (up + down) < down
        self.p = self.p + (up if is_up else -down) * v
        at = np.flatnonzero(moves)[(room_up if is_up else room_down).argmin()]
        self.p[at] = round(self.p[at])
        settled = (self.p < 1e-9) | (self.p > 1 - 1e-9)
        done = [(self.tags.pop(i), int(self.p[i] > 0.5)) for i in np.flatnonzero(settled)[::-1].tolist()]
        self.p, self.size = self.p[~settled], self.size[~settled]
        return done

    def step(self) -> list[tuple]:
        v = self.direction()
        return [] if v is None else self.move(v)

    def finish(self) -> list[tuple]:
        """Settle all but what no move is left for."""
        done = []
        while settled := self.step():
            done += settled
        return done

    def land(self) -> list[tuple]:
        """Settle what :meth:`finish` leaves: first along the constraint on words alone, then by its probability."""
        done = []
        while len(self.tags) > 1:
            v = np.zeros(len(self.tags))
            v[:2] = (self.size[1], -self.size[0]) if self.size[:2].any() else (1.0, -1.0)
            done += self.move(v / np.abs(v).max())
        return done + [(t, int(self.rng.random() < p)) for t, p in zip(self.tags, self.p.tolist(), strict=True)]


def round_largest(batches):
    """``picked`` of documents too large to draw, in sorted Arrow batches: sources one by one, each document to the outcome nearer to what the probabilities promise so far."""
    import pyarrow as pa

    current, off = None, 0.0
    for batch in batches:
        picked = []
        for row in batch.to_pylist():
            if current is None or row["source"] != current[0]:
                current, off = (row["source"],), 0.0
            p, size = row["p"], row["size"]
            x = int(abs(off + (1 - p) * size) < abs(off - p * size))
            off += (x - p) * size
            picked.append(x)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(picked, pa.int32())], names=[*batch.schema.names, "picked"])


def fly(batches, keys: list[str], last: bool, seed: str):
    """Runs of equal ``keys`` in sorted Arrow batches fly one by one; ``picked`` is 0, 1 or, before the last level, null for those that stay open."""
    import pyarrow as pa

    flight, current, schema = None, None, None

    def close():
        out = [{**tag, "picked": x} for tag, x in flight.finish()]
        if last:
            return out + [{**tag, "picked": x} for tag, x in flight.land()]
        return out + [{**tag, "p": p, "picked": None} for tag, p in zip(flight.tags, flight.p.tolist(), strict=True)]

    for batch in batches:
        schema = schema or batch.schema.append(pa.field("picked", pa.int32()))
        out = []
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if flight is None or key != current:
                out += close() if flight else []
                current, flight = key, Flight(random.Random(f"{seed} {key!r}"))
            out += [{**tag, "picked": x} for tag, x in flight.add(row["p"], row["size"], row)]
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    if flight and (out := close()):
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def plan_mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 0, near: float = 0.02) -> DataFrame:
    """(doc_id, source, text_hash, size, source_size, target, copies, taken, level) of every row; ``copies`` 0, 1 or 2 and more for a larger ``most``; ``level`` of
    the flight that settled it, 0 the first, -1 for none: its copies are certain or it is too large to draw.

    Texts are read once, for their sizes. What is shuffled after that are rows of numbers, by chunk, over the session's number of partitions; each partition streams many chunks.
    """
    measured = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), text_hash().alias("text_hash"))
    sizes = staged(measured, "mix-sizes")
    sources = staged(targets_of(sizes, weights, share, most), "mix-sources")
    rows = sizes.alias("a").join(sources.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("doc_id", "a.source", "size", "text_hash", "source_size", "n_docs", "target")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.when(ratio > most - 1e-9, F.floor(F.lit(most))).otherwise(F.floor(ratio + 1e-9))
    rows = rows.withColumn("whole", whole.cast("int")).withColumn("p", F.greatest(F.lit(0.0), ratio - F.col("whole")))
    rows = rows.withColumn("p", F.when(F.col("p") < 1e-9, F.lit(0.0)).otherwise(F.col("p")))
    h = F.xxhash64("doc_id", F.col("doc_id").isNull(), "text_hash", F.lit(seed))
    chunks = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / CHUNK_ROWS)).cast("long")
    rows = rows.withColumn("h", h).withColumn("chunk", F.pmod(F.xxhash64("h", F.lit(7)), chunks)).drop("n_docs")
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", picked int"
    p, size, rest = F.col("p"), F.col("size"), F.col("source_size") - F.col("size")
    off = F.greatest((1 - p) * size - p * rest, p * size - (1 - p) * rest)
    drawn, large = rows.where(off <= near * F.col("target")), rows.where(off > near * F.col("target"))
    large = large.repartition("source").sortWithinPartitions("source", F.col("size").desc(), "h", "doc_id", "text_hash")
    large = staged(large.mapInArrow(round_largest, schema), "mix-large")
    over = large.groupBy("source").agg(F.sum(size * (F.col("picked") - p)).alias("over"), F.sum("size").alias("large_size"))
    shift = F.coalesce(F.col("over") / F.greatest(F.col("source_size") - F.col("large_size"), F.lit(1)), F.lit(0.0))
    shifted = F.when(p > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), p - shift))).otherwise(p)
    drawn = drawn.alias("a").join(over.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left")
    drawn = drawn.select(*[shifted.alias(c) if c == "p" else F.col(f"a.{c}").alias(c) for c in rows.columns])
    certain = drawn.where("p <= 0 or p >= 1").withColumn("picked", F.col("p").cast("int"))
    settled = certain.unionByName(large).withColumn("level", F.lit(-1))
    flying, level = drawn.where("p > 0 and p < 1"), 0
    left = -(-(sources.agg(F.max("n_docs")).first()[0] or 1) // CHUNK_ROWS)
    while True:
        dealt = flying.repartition("source", "chunk").sortWithinPartitions("source", "chunk", F.col("size").desc(), "h", "doc_id", "text_hash")
        last = left == 1
        name = f"{seed} {level}"
        flown = staged(dealt.mapInArrow(lambda b, last=last, name=name: fly(b, ["source", "chunk"], last, name), schema), "mix-flight")
        settled = settled.unionByName(flown.where("picked is not null").withColumn("level", F.lit(level)))
        if last:
            break
        flying = flown.where("picked is null").drop("picked").withColumn("chunk", F.floor(F.col("chunk") / FAN).cast("long"))
        left, level = -(-left // FAN), level + 1
    copies = F.col("whole") + F.col("picked")
    return settled.select("doc_id", "source", "text_hash", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"), "level")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5_cube_mix: how many words the mix takes of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return plan_mix(docs).select("doc_id", "size", "source_size", "target", "taken")
