"""Edit distances. They count code points; wrap operands in ``as_bytes`` to count bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .composition import count_mismatches


def as_bytes(text: Column) -> Column:
    """One letter for each byte of the UTF-8 form."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def hamming(a: Column, b: Column) -> Column:
    """Differing positions; an error for unequal lengths."""
    return F.when(F.length(a) == F.length(b), count_mismatches(a, b)).when(
        F.length(a) != F.length(b), F.raise_error(F.lit("hamming: lengths differ")).cast("int")
    )


def levenshtein(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def bounded_levenshtein(a: Column, b: Column, k: int) -> Column:
    """The distance, or null if it is over k. The length test spares most work in joins."""
    return F.when(F.abs(F.length(a) - F.length(b)) <= k, F.nullif(F.levenshtein(a, b, min(k, 2**31 - 1)), F.lit(-1)))
