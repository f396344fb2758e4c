"""Quality scores: Phred, Solexa, error probabilities and their letters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What each encoding adds to a score.
OFFSETS = {"sanger": 33, "solexa": 64, "illumina_1_3": 64, "illumina_1_5": 64, "illumina_1_8": 33}


def _rounded(x: Column, low: int, high: int) -> Column:
    """Nearest whole number, halves away from zero, inside the range."""
    return F.least(F.greatest(F.round(x), F.lit(float(low))), F.lit(float(high))).cast("int")


def error_probability(phred: Column) -> Column:
    return F.pow(F.lit(10.0), -phred / F.lit(10.0))


def phred_from_probability(p: Column) -> Column:
    return F.when(p <= 0, F.lit(255)).otherwise(_rounded(-10 * F.log10(p), 0, 255))


def solexa_to_phred(solexa: Column) -> Column:
    return _rounded(10 * F.log10(F.pow(F.lit(10.0), solexa / F.lit(10.0)) + 1), 0, 255)


def phred_to_solexa(phred: Column) -> Column:
    """Phred 0 is Solexa -5."""
    inner = F.pow(F.lit(10.0), phred / F.lit(10.0)) - 1
    return F.when(phred == 0, F.lit(-5)).otherwise(_rounded(10 * F.log10(F.nullif(inner, F.lit(0.0))), -128, 127))


def offset(encoding: str) -> int:
    return OFFSETS[encoding]


def decode_phred(letter: Column, encoding: str, strict: bool = True) -> Column:
    """Score of a letter; an error for a letter under the encoding's range, or null if not strict."""
    raw = F.ascii(letter) - OFFSETS[encoding]
    if encoding == "solexa":
        return solexa_to_phred(raw)
    good = F.when(raw >= 0, raw)
    return good.when(raw < 0, F.raise_error(F.lit("quality letter under the encoding's range")).cast("int")) if strict else good


def encode_phred(phred: Column, encoding: str) -> Column:
    return F.chr((phred_to_solexa(phred) if encoding == "solexa" else phred) + OFFSETS[encoding])
