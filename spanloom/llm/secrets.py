"""Operator 4: secrets by a battery of randomness tests, in DataFrame functions.

Base kinds are patterns with a least length; all of their matches stay. Besides, every run of 16 or more token characters with a letter is a candidate (digits alone may be random and are
numbers). Its encoding is inferred (hexadecimal, base 32, lower alphanumeric, base 64), and under "each symbol of that alphabet is equally likely and independent"
four tests give p-values: chi-squared of the symbol counts, chi-squared of the counts of its classes (small and capital letters, the rest), the number of runs above and below the
middle of the alphabet, and serial correlation at lag 1. Fisher's sum makes one score of the four.

A candidate is a discovery if its score is *not* small, so the false ones are ordinary words that look random. Their distribution is measured: tokens of
letters in a single case are decoys, and are never reported themselves. By stratum of length, the share of decoys at or above a score estimates that of other words; it is
drawn towards the share of all strata by the weight of ``PRIOR`` decoys, so that strata with few decoys have an estimate as well. Scores are accepted from
the lowest at which that share of all other candidates of the stratum, as if none were random, is at most ``rate`` of those accepted. Candidates and decoys are
counted over the whole corpus, in bins of the score. Without any decoy nothing is added.

Rows: null text has no span; repeated rows and ids are separate documents; an empty table gives no row; only doc_id and text are read. Added spans
never overlap base spans. Places are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import spans
from spanloom.llm.decontaminate import held
from spanloom.staging import staged

KINDS = ["assign", "access", "hex", "token"]
ASSIGN = r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]++)"
PATTERNS = {
    0: ASSIGN,
    1: r"AKIA[A-Z0-9]{16,}+",
    2: r"(?<![0-9a-f])[0-9a-f]{24,}+",
    3: r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}",
}
#: Inferred encodings, narrowest first: name, pattern, alphabet in order.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = [
    ("hex", "^[0-9a-f]+$", DIGITS + "abcdef"),
    ("upper hex", "^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("base32", "^[A-Z2-7]+={0,2}$", UPPER + "234567"),
    ("lower", "^[0-9a-z]+$", DIGITS + LOWER),
    ("base64", "", UPPER + LOWER + DIGITS + "+/"),
]
BINS = 40
STRATA = (20, 24, 32, 40, 64, 128)
PRIOR = 10


def normal_tail(z: Column) -> Column:
    """Upper tail of the standard normal, by a logistic approximation (error under 2e-4)."""
    return 1 / (1 + F.exp(F.least(F.lit(700.0), F.greatest(F.lit(-700.0), 1.5976 * z + 0.070566 * z * z * z))))


def symbols(token: Column) -> Column:
    """A token without padding, in the standard base 64 alphabet."""
    return F.translate(F.rtrim(F.translate(token, "=", " ")), "-_", "+/")


def measures(plain: Column) -> Column:
    """struct(k, squares, classes, kinds, ones, runs, sums) of a token under the alphabet of k symbols of its encoding; ``plain`` must be a plain column.

    squares: of the symbols' counts; classes: squares of the classes' counts by their expected shares, kinds: number of classes; ones: symbols of the alphabet's upper half; runs: of equal halves; sums: of positions in the alphabet, their squares
    and their products with the next.
    """
    found = None
    for _, pattern, alphabet in reversed(ENCODINGS):
        k, half = len(alphabet), len(alphabet) // 2
        squares = F.aggregate(F.array(*map(F.lit, alphabet)), F.lit(0.0), lambda total, c: total + F.pow((F.length(plain) - F.length(F.replace(plain, c, F.lit("")))).cast("double"), F.lit(2.0)))
        sizes = {c: sum(x in c for x in alphabet) for c in (LOWER, UPPER) if any(x in c for x in alphabet)}
        counts = {c: F.length(plain) - F.length(F.translate(plain, c, "")) for c in sizes}
        rest = F.length(plain) - sum(counts.values(), F.lit(0))
        classes = sum((F.pow(counts[c].cast("double"), F.lit(2.0)) * (k / n) for c, n in sizes.items()), F.pow(rest.cast("double"), F.lit(2.0)) * (k / (k - sum(sizes.values()))))
        bits = F.translate(plain, alphabet, "0" * half + "1" * (k - half))
        codes = F.transform(F.filter(F.split(plain, ""), lambda c: c != ""), lambda c: (F.instr(F.lit(alphabet), c) - 1).cast("double"))
        start = F.struct(F.lit(None).cast("double").alias("last"), *[F.lit(0.0).alias(x) for x in ("x", "xx", "xy")])
        sums = F.aggregate(codes, start, lambda a, x: F.struct(x.alias("last"), (a["x"] + x).alias("x"), (a["xx"] + x * x).alias("xx"), (a["xy"] + F.coalesce(a["last"] * x, F.lit(0.0))).alias("xy")))
        m = F.struct(F.lit(k).alias("k"), squares.alias("squares"), classes.alias("classes"), F.lit(len(sizes) + 1).alias("kinds"), F.length(F.replace(bits, F.lit("0"), F.lit(""))).cast("double").alias("ones"), F.regexp_count(bits, F.lit("0+|1+")).cast("double").alias("runs"), sums.alias("sums"))
        found = m if found is None else F.when(plain.rlike(pattern), m).otherwise(found)
    return found


def p_values(m: Column, n: Column) -> tuple[Column, Column, Column, Column]:
    """p-values of the four tests from :func:`measures` of n symbols."""
    k = m["k"].cast("double")
    chi2, cube = m["squares"] * k / n - n, 2.0 / (9 * (k - 1))
    chi_p = normal_tail((F.pow(F.greatest(chi2, F.lit(0.0)) / (k - 1), F.lit(1 / 3)) - (1 - cube)) / F.sqrt(cube))
    split = F.greatest(m["classes"] / n - n, F.lit(0.0))
    class_p = F.when(m["kinds"] == 2, 2 * normal_tail(F.sqrt(split))).otherwise(F.exp(-split / 2))
    mean = 2 * m["ones"] * (n - m["ones"]) / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    runs_p = F.when(var <= 0, 0.0).otherwise(2 * normal_tail(F.abs(m["runs"] - mean) / F.sqrt(F.greatest(var, F.lit(1e-9)))))
    x, xx, xy = (m["sums"][name] for name in ("x", "xx", "xy"))
    spread = xx - x * x / n
    serial = F.when(spread <= 0, 1.0).otherwise((xy - x * x / n) / F.greatest(spread, F.lit(1e-9)))
    serial_p = 2 * normal_tail(F.abs(serial) * F.sqrt(n))
    return tuple(F.least(F.lit(1.0), p) for p in (chi_p, class_p, runs_p, serial_p))


def tested(rows: DataFrame, token: Column) -> DataFrame:
    """``rows`` with p1 to p4 of ``token``, null where that is. Each step is held in a column, so that none is computed twice."""
    rows = rows.select("*", held(F.when(token.isNotNull(), symbols(token))).alias("plain"))
    rows = rows.select("*", held(F.when(F.col("plain").isNotNull(), measures(F.col("plain")))).alias("m"))
    ps = p_values(F.col("m"), F.length("plain").cast("double"))
    return rows.withColumns({f"p{i + 1}": F.when(F.col("m").isNotNull(), p) for i, p in enumerate(ps)}).drop("plain", "m")


def fisher(ps: tuple[Column, ...]) -> Column:
    """p-value of Fisher's sum of independent tests (chi-squared, two degrees for each)."""
    x = -sum(F.ln(F.greatest(p, F.lit(1e-300))) for p in ps)
    term, total = F.lit(1.0), F.lit(1.0)
    for i in range(1, len(ps)):
        term = term * x / i
        total = total + term
    return F.exp(-x) * total


def stratum(length: Column) -> Column:
    return sum(((length >= bound).cast("int") for bound in STRATA), F.lit(0))


def score_bin(p: Column) -> Column:
    """0 for scores under 1e-10, ``BINS`` - 1 for those near 1, even in the logarithm."""
    return F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.log10(F.greatest(p, F.lit(1e-300))) + 10) / 10 * BINS))).cast("int")


def thresholds(counts: list[tuple[int, int, bool, int]], rate: float) -> dict[int, int]:
    """Lowest accepted bin of each stratum from rows (stratum, bin, decoy, n)."""
    n = {True: {}, False: {}}
    for s, b, decoy, k in counts:
        n[decoy].setdefault(s, [0] * BINS)[b] += k
    everywhere = [sum(bins[b] for bins in n[True].values()) for b in range(BINS)]
    found: dict[int, int] = {}
    if not sum(everywhere):
        return found
    for s, targets in n[False].items():
        decoys = n[True].get(s, [0] * BINS)
        for b in range(BINS):
            general = (sum(everywhere[b:]) + 1) / (sum(everywhere) + 2)
            share = (sum(decoys[b:]) + PRIOR * general) / (sum(decoys) + PRIOR)
            if sum(targets[b:]) and sum(targets) * share <= rate * sum(targets[b:]):
                found[s] = b
                break
    return found


def candidates(docs: DataFrame) -> DataFrame:
    """Base spans, and tokens with stratum, score bin and decoy flag; one row with a null kind for each document. Written to the shared folder."""
    text = F.col("text")
    guards = {0: text.rlike("[:=]"), 1: F.contains(text, F.lit("AKIA")), 2: text.rlike("[0-9a-f]{24}"), 3: text.rlike("[A-Za-z0-9+/_-]{16}")}
    rows = spans.found(docs, {k: (p, guards[k]) for k, p in PATTERNS.items()})
    long_enough = F.length(F.regexp_extract("hit", ASSIGN, 1)) >= 6
    base = F.when(F.col("kind") == 0, long_enough).otherwise(F.col("kind") < 3) & F.col("hit").isNotNull()
    rows = rows.withColumn("base", F.coalesce(base, F.lit(False))).withColumn("keep", F.col("hit").isNotNull() & (F.col("base") | (F.col("kind") == 3) & F.col("hit").rlike("[A-Za-z]")))
    rows = rows.where(F.col("keep") | F.col("hit").isNull() & (F.col("kind") == 0))
    token = F.col("keep") & (F.col("kind") == 3)
    rows = tested(rows, F.when(token, F.col("hit")))
    score = fisher((F.col("p1"), F.col("p2"), F.col("p3"), F.col("p4")))
    rows = rows.withColumns({"bin": F.when(token, score_bin(score)), "stratum": F.when(token, stratum(F.length("hit"))), "decoy": F.when(token, F.col("hit").rlike("^[A-Z]?[a-z]+$|^[A-Z]+$"))})
    return rows.select("rid", "doc_id", F.when(F.col("keep"), F.col("kind")).alias("kind"), "start", "end", "base", "bin", "stratum", "decoy")


def detect(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """(rid, doc_id, spans: array of struct(start, kind, end, base)) of every document, in order of start and kind."""
    rows = staged(candidates(docs), "secret-candidates")
    counts = rows.where("kind = 3").groupBy("stratum", "bin", "decoy").agg(F.count(F.lit(1)).alias("n")).collect()
    chosen = F.lit(False)
    for s, b in sorted(thresholds([tuple(c) for c in counts], rate).items()):
        chosen = chosen | ((F.col("stratum") == s) & (F.col("bin") >= b))
    chosen = F.coalesce((F.col("kind") == 3) & ~F.col("decoy") & chosen, F.lit(False))
    rows = rows.withColumn("chosen", F.col("base") | chosen)
    rows = rows.withColumn("clear", spans.apart(rows))
    span = F.when(F.col("chosen") & F.col("clear"), F.struct("start", "kind", "end", "base"))
    return rows.groupBy("rid").agg(F.any_value("doc_id").alias("doc_id"), F.array_sort(F.collect_list(span)).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4_secrets: secrets of every document."""
    found = detect(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.array_remove(F.transform(base, lambda s: s["kind"] != k), True)).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select("doc_id", *counts, F.sha2(spans.joined(base, KINDS).cast("binary"), 256).alias("base_sha256"), spans.joined(F.col("spans"), KINDS).alias("spans"))
