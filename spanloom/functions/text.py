"""Word functions on string columns. All stay inside the JVM; white space is that of Java's ``\\s`` and ``trim``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that word comparison ignores.
IGNORED = ".,!?;:'\""


def jtrim(text: Column) -> Column:
    """Without characters up to U+0020 at either end."""
    return F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def words(text: Column) -> Column:
    """Non-empty words in order."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def count_trimmed(text: Column) -> Column:
    """Number of words, at least 1: a blank text counts as one."""
    return F.size(F.split(jtrim(text), r"\s+"))


def raw_words(text: Column) -> Column:
    """Pieces between runs of white space: a leading empty piece stays, trailing ones go, and "" is one piece."""
    return F.when(text == "", F.array(F.lit(""))).when(text.rlike(r"^\s+$"), F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"\s+$", ""), r"\s+"))


def count_untrimmed(text: Column) -> Column:
    """Number of :func:`raw_words`: leading white space adds one, "" is 1, a blank text 0."""
    return F.size(raw_words(text))


def normalize(word: Column) -> Column:
    """Comparison form of a word: lower case, without ``IGNORED``, trimmed. Words of such characters alone are all equal."""
    return jtrim(F.translate(F.lower(word), IGNORED, ""))


def jaccard(a: Column, b: Column) -> Column:
    """Occurrences of a's words that b has, over both numbers of words less those; not symmetric, and above 1 for repeats."""
    x, y = raw_words(F.lower(a)), raw_words(F.lower(b))
    common = F.size(F.filter(x, lambda w: F.array_contains(y, w)))
    union = F.size(x) + F.size(y) - common
    return F.when(union > 0, common / union).otherwise(F.lit(0.0))


def shorten(text: Column, n: int) -> Column:
    """First n characters and "..." if there are more."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)
