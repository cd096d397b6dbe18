"""Places of regular-expression matches in whole texts, by DataFrame functions alone.

Splitting a text at a pattern gives what lies between the matches, extracting gives the matches; laid side by side and summed up they give
each match's place in code points, the leftmost non-overlapping ones first. The sums run in a window over small rows, so a
text with very many matches costs no more than their number. Patterns must be free of nested backtracking: use possessive repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Code points kept before and after a match.
BEFORE, AFTER = 24, 8


def found(docs: DataFrame, patterns: dict[int, tuple[str, Column | None]]) -> DataFrame:
    """Rows (rid, doc_id, kind, hit, start, end, before, after) of matches, and one with a null hit for each document and pattern.

    ``patterns``: kind to (Java regular expression, cheap condition on ``text`` without which there is no match). ``rid`` numbers
    the rows of ``docs``, so repeated or null ids stay apart.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = []
    for number, (pattern, guard) in patterns.items():
        pieces, hits = F.split("text", pattern, -1), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        if guard is not None:
            pieces, hits = F.when(guard, pieces).otherwise(F.array(F.lit(""))), F.when(guard, hits).otherwise(F.array().cast("array<string>"))
        zipped = F.arrays_zip(pieces.alias("piece"), hits.alias("hit"))

        def row(x, i):
            piece = x["piece"]
            return F.struct(F.lit(number).alias("kind"), i.alias("i"), F.length(piece).alias("skip"), F.right(piece, F.lit(BEFORE)).alias("before"), F.left(piece, F.lit(AFTER)).alias("lead"), x["hit"].alias("hit"))

        parts.append(F.transform(zipped, row))
    exploded = rows.select("rid", "doc_id", F.explode(F.concat(*parts)).alias("x")).select("rid", "doc_id", "x.*")
    order = Window.partitionBy("rid", "kind").orderBy("i")
    length = F.coalesce(F.length("hit"), F.lit(0))
    end = F.sum(F.col("skip").cast("long") + length).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = exploded.withColumns({"end": end, "after": F.lead("lead").over(order)})
    return placed.select("rid", "doc_id", "kind", "hit", (F.col("end") - length).alias("start"), "end", "before", "after")


def apart(rows: DataFrame) -> Column:
    """Whether a row with ``base`` false shares no place with the document's rows with ``base`` true; others true."""
    order = Window.partitionBy("rid").orderBy("start", "end")
    left = F.max(F.when(F.col("base"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    right = F.min(F.when(F.col("base"), F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    clear = (left.isNull() | (left <= F.col("start"))) & (right.isNull() | (right >= F.col("end")))
    return F.when(F.col("base"), True).otherwise(clear)


def joined(spans: Column, names: list[str]) -> Column:
    """``kind:start:end`` of an array of struct(kind, start, end) or struct(start, kind, end), comma-joined."""
    table = F.array(*map(F.lit, names))
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.get(table, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))))
