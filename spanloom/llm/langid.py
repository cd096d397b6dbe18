"""Operator 10: language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word (a run of letters, lower-cased, behind a
word-start mark) may be cut into pieces in many ways; a forward pass sums the products of all of them. Piece probabilities
come from expectation maximisation over the same lattices. A text's score is the sum over its words, and the language with the
largest wins under equal priors.

Fitting reads a bounded sample: up to ``per_lang`` labelled documents of at most ``max_chars`` characters from each language, those
with the smallest hashes among the documents not held out; of a language that has only longer ones, its shortest. Prediction reads every whole text. Runs of letters over
``LONGEST`` characters are cut into parts of that length, in fitting and in prediction alike, and every part counts; segmentations across a cut do not.

Rows: a null text, or one without a letter, is ``und`` with score 0; so is everything if no labelled row could be learned from. Ties go to
the language that sorts first. Rows without doc_id are not held out and not learned from. Repeated rows get equal results; an empty
table gives no row; ``lang_pred``, ``score`` and ``held_out`` of the input are replaced, other columns kept.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.worker import give_back

LONGEST = 40
#: Documents whose new words are scored together.
GROUP = 500
#: Words that are looked up, or scored, together; sums go by such lots, so that equal texts have equal scores whatever else is in memory.
LOT = 10_000
START = "▁"
FLOOR = 1e-7
LETTERS = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def words_of(text: str) -> list[str]:
    words = LETTERS.findall(text.lower())
    if words and not words[0].isalpha() and not any(map(str.isalpha, text)):
        return []
    return words


def parts_of(word: str) -> list[str]:
    """A word behind the start mark, in parts of at most ``LONGEST`` of its characters."""
    return [START + word[:LONGEST], *(word[i : i + LONGEST] for i in range(LONGEST, len(word), LONGEST))]


@dataclass
class Lattice:
    """Words of one length: for each start and piece length, the piece's number; ``unknown`` for a lone letter, ``none`` otherwise."""

    steps: list[tuple[int, int, np.ndarray]]
    length: int
    rows: np.ndarray

    @staticmethod
    def build(words: list[str], pieces: dict[str, int], longest: int) -> list[Lattice]:
        unknown, none = len(pieces), len(pieces) + 1
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_length.setdefault(len(w), []).append(k)
        found = []
        for length, rows in by_length.items():
            group, steps = [words[k] for k in rows], []
            for i in range(length):
                for j in range(i + 1, min(length, i + longest) + 1):
                    ids = np.array([pieces.get(w[i:j], unknown if j == i + 1 else none) for w in group], np.int32)
                    if (ids != none).any():
                        steps.append((i, j, ids))
            found.append(Lattice(steps, length, np.array(rows)))
        return found

    def forward(self, p: np.ndarray) -> np.ndarray:
        """(length + 1, words, languages): total probability of each prefix over all its segmentations."""
        a = np.zeros((self.length + 1, len(self.rows), p.shape[1]))
        a[0] = 1
        for i, j, ids in self.steps:
            a[j] += a[i] * p[ids]
        return a

    def backward(self, p: np.ndarray) -> np.ndarray:
        b = np.zeros((self.length + 1, len(self.rows), p.shape[1]))
        b[-1] = 1
        for i, j, ids in reversed(self.steps):
            b[i] += b[j] * p[ids]
        return b


@dataclass
class Model:
    """Piece probabilities by language; two rows follow the pieces: an unknown letter and no piece."""

    langs: list[str]
    pieces: dict[str, int]
    p: np.ndarray

    def log_likelihoods(self, words: list[str]) -> np.ndarray:
        """(words, languages), the log of the sum over all segmentations of each word."""
        parts, owner = [], []
        for k, w in enumerate(words):
            cut = parts_of(w)
            parts += cut
            owner += [k] * len(cut)
        out = np.zeros((len(words), len(self.langs)))
        longest = max(map(len, self.pieces), default=1)
        for lattice in Lattice.build(parts, self.pieces, longest):
            np.add.at(out, np.array(owner)[lattice.rows], np.log(lattice.forward(self.p)[-1] + 1e-300))
        return out


def vocabulary(path: str) -> list[str]:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]


def fit_counts(counts: dict[str, dict[str, int]], pieces: list[str], rounds: int = 4) -> Model:
    """Model from word counts by language, by expectation maximisation over the words' lattices."""
    langs = sorted(counts)
    number = {x: i for i, x in enumerate(pieces)}
    column = {g: i for i, g in enumerate(langs)}
    weights: dict[str, np.ndarray] = {}
    for g in langs:
        for w, n in counts[g].items():
            for part in parts_of(w):
                weights.setdefault(part, np.zeros(len(langs)))[column[g]] += n
    parts = sorted(weights)
    weight = np.array([weights[x] for x in parts], float).reshape(len(parts), len(langs))
    lattices = Lattice.build(parts, number, max(map(len, pieces), default=1))
    seen = np.zeros((len(pieces) + 2, len(langs)))
    for lattice in lattices:
        for _, _, ids in lattice.steps:
            np.add.at(seen, ids, weight[lattice.rows])

    def probabilities(c: np.ndarray) -> np.ndarray:
        c = c[: len(pieces)]
        smooth = 0.05 * (c.sum(1, keepdims=True) > 0)
        p = np.maximum((c + smooth) / np.maximum((c + smooth).sum(0), 1e-9), FLOOR)
        return np.vstack([p, np.full((1, len(langs)), FLOOR), np.zeros((1, len(langs)))])

    p = probabilities(seen)
    for _ in range(rounds):
        expected = np.zeros_like(seen)
        for lattice in lattices:
            a, b = lattice.forward(p), lattice.backward(p)
            scale = weight[lattice.rows] / np.maximum(a[-1], 1e-300)
            for i, j, ids in lattice.steps:
                np.add.at(expected, ids, a[i] * p[ids] * b[j] * scale)
        p = probabilities(expected)
    return Model(langs, number, p)


def fit(docs: DataFrame, per_lang: int = 150, max_chars: int = 20_000, vocabulary_file: str | None = None) -> Model:
    """Learn from up to ``per_lang`` documents of each non-null ``lang``, none of them held out, none over ``max_chars`` characters unless all are.

    Candidates are cut down by a hash threshold from the languages' counts where the rows are, so the driver gets about three times the sample.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    u = F.xxhash64("doc_id", F.length("text"))
    fits = F.length("text") <= max_chars
    shortest = F.min(F.struct(F.length("text"), u, "doc_id"))
    totals = {r["lang"]: (r["n"], r["first"]) for r in usable.groupBy("lang").agg(F.count_if(fits).alias("n"), shortest.alias("first")).collect()}
    pieces = vocabulary(vocabulary_file or public_tokenizers.path("piece_bpe_32k.model"))
    counts: dict[str, dict[str, int]] = {}
    if totals:
        share = F.create_map(*[F.lit(x) for lang, (n, _) in totals.items() for x in (lang, min(1.0, 3.0 * per_lang / max(1, n)))])
        near = usable.where((F.shiftrightunsigned(u, 11) / float(1 << 53) < share[F.col("lang")]) & fits)
        for lang, (n, first) in totals.items():
            if not n:
                near = near.unionByName(usable.where((F.col("lang") == lang) & (F.length("text") == first[0]) & (F.col("doc_id") == first[2])).orderBy("text").limit(1))
        drawn = sorted(near.select("lang", u.alias("u"), "doc_id", "text").collect(), key=lambda r: (r["lang"], r["u"], r["doc_id"], r["text"]))
        taken: dict[str, int] = {}
        for r in drawn:
            if taken.setdefault(r["lang"], 0) < per_lang:
                taken[r["lang"]] += 1
                c = counts.setdefault(r["lang"], {})
                for w in words_of(r["text"]):
                    c[w] = c.get(w, 0) + 1
    return fit_counts({g: c for g, c in counts.items() if c}, pieces)


def predict(docs: DataFrame, model: Model, most: int = 250_000) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``. Workers keep the likelihoods of up to ``most`` words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judged(texts):
        import pandas as pd

        model = shared.value
        kept, table = model.__dict__.setdefault("kept", ({}, np.zeros((max(most, LOT), max(1, len(model.langs))))))
        langs, scores = [], []

        def rows_of(words):
            return np.fromiter(map(kept.__getitem__, words), np.int64, len(words))

        def learn(words):
            new = list({w for w in words if w not in kept})
            if len(kept) + len(new) > most:
                kept.clear()
                new = list(set(words))
            for j in range(0, len(new), LOT):
                table[len(kept) : len(kept) + len(new[j : j + LOT])] = model.log_likelihoods(new[j : j + LOT])
                kept.update(zip(new[j : j + LOT], range(len(kept), len(kept) + len(new)), strict=False))

        for i in range(0, len(texts), GROUP):
            group = [words_of(t) if t and model.langs else [] for t in texts.iloc[i : i + GROUP]]
            several = len({w for words in group for w in words}) <= most
            if several:
                learn([w for words in group for w in words])
            for words in group:
                if not words:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                total = np.zeros(len(model.langs))
                for j in range(0, len(words), LOT):
                    if not several:
                        learn(words[j : j + LOT])
                    total += table[rows_of(words[j : j + LOT])].sum(0)
                best = int(total.argmax())
                langs.append(model.langs[best])
                scores.append(float(1 / np.exp(np.minimum(total - total[best], 0)).sum()))
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    def judge(batches):
        yield from map(judged, batches)
        give_back()

    judge = F.pandas_udf(judge, "lang_pred string, score double", F.PandasUDFType.SCALAR_ITER)
    plain = docs.drop("lang_pred", "score")
    return plain.withColumn("lang_guess__", judge(F.col("text"))).select(*plain.columns, F.col("lang_guess__.lang_pred"), F.col("lang_guess__.score"))


def identify(docs: DataFrame, **fitting) -> DataFrame:
    """Fit on the labelled part of ``docs``, then predict all: ``docs`` with held_out, lang_pred and score."""
    return predict(docs.drop("held_out"), fit(docs, **fitting)).withColumn("held_out", held_out(F.col("doc_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10_langid: a language and score for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score")
