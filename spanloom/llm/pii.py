"""Operator 2: personal data by candidate gradient boosting, in DataFrame functions.

Base kinds are patterns with a check (octets, digits, the Luhn sum); all of their matches that pass are kept. High-recall generators propose
further spans that may overlap them: runs of seven or more digits with separators that no letter touches, and names around an "at" sign or word (parts of at most 64 characters, at most
32 of them behind the "at"). Each candidate gets binned features of its format (digits, separators, grouping, whether a check of its size passes) and of its context
(characters and words beside it). The marks that base patterns ask for are masked: a leading plus is no feature, and "at" and dots in words count as the signs, so what is learned
of marked candidates holds for others.

There are no labels of personal data, so boosted trees learn from weak ones, counted by feature cell over all candidates: those that a base span covers are
positive; negative are candidates of a base kind's size that fail its check, calendar dates, numbers in groups of thousands, plain runs of digits without a telling word
before them, and names around an "at" in plain words with a blank beside a dot, as between sentences. Half of the documents grow the trees, half calibrate them and set
the threshold for ``precision``. The trees and the threshold then judge every candidate that no base span overlaps, whatever its weak label; those
at or above it are added. Without both classes, or where no threshold reaches the precision, nothing is added.

Rows: null text has no span; repeated rows and ids are separate documents; an empty table gives no row; very long texts are searched whole; only doc_id and text are read.
Added spans never overlap base spans. Places are code points, ends exclusive.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import boosting, spans
from spanloom.staging import staged

KINDS = ["email", "ip", "card", "phone", "number", "handle"]
LOCAL = r"[A-Za-z0-9._%+-]"
#: Linear-time forms of the base patterns: a match can only start where its run does, or where the last match ended.
PATTERNS = {
    0: rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    1: r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    2: r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,}+",
    3: r"\+[0-9][ ().0-9-]+[0-9]",
    4: r"(?<![0-9A-Za-z])(?<![0-9][ ().-])[0-9](?:[ ().-]{0,2}[0-9]){6,}+(?![A-Za-z])",
    5: rf"(?<!{LOCAL}){LOCAL}{{1,64}}+ ?(?:@|\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{{1,64}}+(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{{2,64}}+){{1,32}}+",
}
#: Ways to write the marks of an address.
AT, DOT = r" ?(?:@|\(at\)|\[at\]| at ) ?", r" ?(?:\.|\(dot\)|\[dot\]| dot ) ?"
#: A dot with a blank beside it, as between sentences.
GAP = r" \.|\. "
OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
DATE = r"^(?:(?:19|20)[0-9]{2}[ .-](?:0?[1-9]|1[0-2])[ .-](?:0?[1-9]|[12][0-9]|3[01])|(?:0?[1-9]|[12][0-9]|3[01])[ .-](?:0?[1-9]|1[0-2])[ .-](?:19|20)[0-9]{2})$"
THOUSANDS = r"^[0-9]{1,3}(?:\.[0-9]{3}){2,}+$"
KEYWORDS = r"(?i)(?:phone|mobile|call|fax|tel|contact|card|visa|account|acct|iban|ssn|mail|host|address)[^A-Za-z0-9]{0,4}$"
FEATURES = ["f_gap", "f_digits", "f_seps", "f_dots", "f_groups", "f_check", "f_letters", "f_word", "f_before", "f_after"]


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits has a Luhn sum divisible by 10."""
    back = F.reverse(digits)
    total = F.lit(0)
    for i in range(19):
        d = F.coalesce(F.try_to_number(F.substring(back, i + 1, 1), F.lit("9")).cast("int"), F.lit(0))
        total = total + (d if i % 2 == 0 else d * 2 - F.when(d > 4, 9).otherwise(0))
    return total % 10 == 0


def base_valid() -> Column:
    digits = digits_of(F.col("hit"))
    n = F.length(digits)
    kind = F.col("kind")
    octets = F.col("hit").rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    return F.when(kind == 0, True).when(kind == 1, octets).when(kind == 2, n.between(13, 19) & luhn(F.substring(digits, 1, 19))).when(kind == 3, n.between(9, 15)).otherwise(False)


def features() -> dict[str, Column]:
    """Format and context features of a candidate, each a small integer."""
    hit = F.col("hit")
    plain = F.when(F.col("kind") == 5, F.regexp_replace(F.regexp_replace(hit, AT, "@"), DOT, ".")).otherwise(hit)
    n = F.length(digits_of(hit))
    seps = F.length(F.regexp_replace(plain, "[A-Za-z0-9]", ""))
    before = F.regexp_replace("before", r"\+$", "")
    last, first = F.right(before, F.lit(1)), F.left(F.coalesce("after", F.lit("")), F.lit(1))

    def side(c: Column) -> Column:
        return F.when(c == "", 0).when(c.rlike(r"^\s$"), 1).when(c.rlike("^[A-Za-z0-9]$"), 2).when(c.rlike(r"^[.,;:!?)]$"), 3).otherwise(4)

    groups = F.when(hit.rlike(r"^[0-9]+$"), 0).when(hit.rlike(r"^[0-9]{4}(?:[ -][0-9]{4}){3}$"), 1).when(hit.rlike(r"[0-9]{3}[ )./-]+[0-9]{3}[ ./-]+[0-9]{4}$"), 2).when(hit.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), 3).otherwise(4)
    return {
        "f_gap": F.when((F.col("kind") == 5) & hit.rlike(GAP), 1).otherwise(0),
        "f_digits": F.when(n < 7, F.least(n, F.lit(6))).when(n < 13, n).when(n < 17, n).when(n < 20, F.lit(17)).otherwise(F.lit(18)),
        "f_seps": F.least(seps, F.lit(6)),
        "f_dots": F.least(F.length(F.regexp_replace(plain, r"[^.]", "")), F.lit(4)),
        "f_groups": groups,
        "f_check": check(),
        "f_letters": F.when(hit.rlike("[A-Za-z]"), 1).otherwise(0),
        "f_word": F.when(before.rlike(KEYWORDS), 1).otherwise(0),
        "f_before": side(last),
        "f_after": side(first),
    }


def check() -> Column:
    """Of a number with a size that a check is for: 1 if it passes, 2 if it fails, 3 for a date or groups of thousands; otherwise 0."""
    hit = F.col("hit")
    digits = digits_of(hit)
    n = F.length(digits)
    octets = hit.rlike(r"^[0-9]+(?:\.[0-9]+){3}$")
    card = hit.rlike("^[0-9](?:[ -]?[0-9])++$") & n.between(13, 19)
    found = F.when(octets, F.when(hit.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"), 1).otherwise(2)).when(card, F.when(luhn(F.substring(digits, 1, 19)), 1).otherwise(2))
    found = found.when(n > 19, 2).when(hit.rlike(DATE) | hit.rlike(THOUSANDS), 3)
    return F.when(F.col("kind") == 4, found.otherwise(0)).otherwise(0)


def against() -> Column:
    """Weak negatives: what a check, a calendar or groups of thousands speak against, plain runs of digits without a telling word, and sentences around an "at"."""
    number = (F.col("f_check") >= 2) | (F.col("f_check") == 0) & (F.col("f_groups") == 0) & (F.col("f_word") == 0)
    return ((F.col("kind") == 4) & number) | ((F.col("kind") == 5) & ~F.col("hit").rlike("[@(\\[]") & F.col("hit").rlike(GAP))


def candidates(docs: DataFrame) -> DataFrame:
    """Base spans and candidates of all texts with features, one row with a null kind for each document; written to the shared folder."""
    text = F.col("text")
    guards = {0: F.contains(text, F.lit("@")), 1: text.rlike(r"[0-9]\.[0-9]"), 2: text.rlike("[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]"), 3: F.contains(text, F.lit("+")), 4: text.rlike("[0-9][ ().-]{0,2}[0-9][ ().-]{0,2}[0-9]"), 5: F.contains(text, F.lit("@")) | F.contains(text, F.lit("at")) & text.rlike(r"[(\[ ]at[)\] ]")}
    rows = spans.found(docs, {k: (p, guards[k]) for k, p in PATTERNS.items()})
    rows = rows.withColumn("base", F.col("hit").isNotNull() & F.coalesce(base_valid(), F.lit(False)))
    rows = rows.withColumn("keep", F.col("hit").isNotNull() & (F.col("base") | (F.col("kind") > 3)))
    marked = rows.where(F.col("keep") | F.col("hit").isNull() & (F.col("kind") == 0))
    marked = marked.withColumns(features()).withColumn("against", F.col("keep") & against())
    return marked.select("rid", "doc_id", F.when(F.col("keep"), F.col("kind")).alias("kind"), "start", "end", "base", "against", *FEATURES)


def train(rows: DataFrame, precision: float) -> tuple[boosting.Boosted, float] | None:
    """Trees and threshold from the counts of weakly labelled candidates by feature cell; the documents of one half by hash grow the trees, the others calibrate them."""
    half = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(2)) == 0
    counts = [F.count_if(F.col(label) & side).alias(f"{label}_{i}") for i, side in enumerate((half, ~half)) for label in ("covered", "against")]
    cells = rows.where("kind > 3 and (covered or against)").withColumn("against", ~F.col("covered")).groupBy(*FEATURES).agg(*counts).collect()
    cells = sorted(tuple(r) for r in cells)
    if not cells:
        return None
    n = len(FEATURES)
    x = np.array([c[:n] for c in cells], np.int64)
    pos, neg, held_pos, held_neg = np.array([c[n:] for c in cells], float).T
    if not (pos.sum() and neg.sum() and held_pos.sum() and held_neg.sum()):
        return None
    model = boosting.calibrate(boosting.boost(x, pos, neg), x, held_pos, held_neg)
    at = boosting.threshold(model, x, held_pos, held_neg, precision)
    return None if at is None else (model, at)


def detect(docs: DataFrame, precision: float = 0.98) -> DataFrame:
    """(rid, doc_id, spans: array of struct(kind, start, end, base)) of every document, in order of kind and start."""
    rows = staged(candidates(docs), "pii-candidates")
    clear = spans.apart(rows)
    rows = staged(rows.where("kind is not null").withColumn("covered", ~clear), "pii-spans").unionByName(rows.where("kind is null").withColumn("covered", F.lit(None).cast("boolean")))
    fitted = train(rows, precision)
    score = F.expr(fitted[0].sql(FEATURES)) >= fitted[1] if fitted else F.lit(False)
    chosen = F.col("base") | ((F.col("kind") > 3) & ~F.col("covered") & score)
    span = F.when(chosen, F.struct("kind", "start", "end", "base"))
    return rows.groupBy("rid").agg(F.any_value("doc_id").alias("doc_id"), F.array_sort(F.collect_list(span)).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2_pii: personal data of every document."""
    found = detect(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.array_remove(F.transform(base, lambda s: s["kind"] != k), True)).cast("long").alias(f"n_{KINDS[k]}") for k in range(4)]
    return found.select("doc_id", *counts, F.sha2(spans.joined(base, KINDS).cast("binary"), 256).alias("base_sha256"), spans.joined(F.col("spans"), KINDS).alias("spans"))
