"""Counts of letters and GC ratios. Null sequences give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_any(seq: Column, letters: str) -> Column:
    """Letters of seq that are in the set."""
    return F.length(seq) - F.length(F.translate(seq, "".join(dict.fromkeys(letters)), "")) if letters else F.length(seq) * 0


def gc_count(seq: Column) -> Column:
    return count_any(seq, "GCgc")


def gc_content(seq: Column) -> Column:
    """Share of G and C as a float; NaN for an empty sequence."""
    n = F.length(seq)
    return F.when(n == 0, F.lit(float("nan"))).otherwise(gc_count(seq) / F.nullif(n, F.lit(0))).cast("float")


def gc3_content(seq: Column) -> Column:
    """GC share of every third letter from the first on."""
    return gc_content(F.regexp_replace(seq, "(?s)(.).{0,2}", "$1"))


def count_mismatches(a: Column, b: Column) -> Column:
    """Positions at which sequences of equal length differ; one pass over their letters."""
    letters = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y)
    return F.when(a.isNotNull() & b.isNotNull(), F.size(F.filter(letters, lambda d: d)))
