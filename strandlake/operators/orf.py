"""Open reading frames on the forward strand.

A frame is found inside its row, in one scan over start and stop codons, so nothing is shuffled
and a sequence never becomes a row for each letter. The scan is an Arrow function: built-in
substrings count letters from the start each time, which squares with the length.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ByteType, LongType, StructField, StructType

from strandlake.functions.columns import list_array, small_batches, unused

ORF = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("offset", ByteType())]))


def scan(seq: str, codons: re.Pattern, starts: frozenset[str], stops: frozenset[str], min_length: int) -> list[tuple[int, int, int]]:
    """(start, end, offset) by end, then start."""
    waiting: tuple[list[int], ...] = ([], [], [])
    out = []
    for m in codons.finditer(seq):
        p, codon = m.start(), m.group(1)
        own = waiting[p % 3]
        if codon in starts:
            own.append(p)
        if codon in stops:
            out += [(s, p + 3, p % 3) for s in own if p + 1 - s > min_length]
            own.clear()
    return out


def codon_pattern(starts: list[str], stops: list[str]) -> re.Pattern:
    """Every place where one of the codons begins."""
    return re.compile(f"(?=({'|'.join(map(re.escape, dict.fromkeys((*starts, *stops))))}))", re.S) if starts or stops else re.compile("(?!)()")


def open_reading_frames(seq: Column, starts: list[str], stops: list[str], min_length: int) -> Column:
    """An array of (start, end, offset): each start codon with the next stop codon of its frame, itself included.

    Kept are those with end - start - 2 > min_length. Codons have three letters and are compared with
    their case. A null sequence gives null.
    """
    if any(len(c) != 3 for c in (*starts, *stops)):
        raise ValueError("codons have three letters")
    codons = codon_pattern(starts, stops)
    first, last = frozenset(starts), frozenset(stops)

    @F.arrow_udf(ORF)
    def found(seqs: pa.Array) -> pa.Array:
        scanned = (None if s is None else scan(s, codons, first, last, min_length) for s in (v.as_py() for v in seqs))
        rows = [None if r is None else np.array(r, np.int64).reshape(-1, 3) for r in scanned]
        columns = ("start", pa.int64()), ("end", pa.int64()), ("offset", pa.int8())
        return list_array(rows, lambda m: pa.StructArray.from_arrays([pa.array(m[:, k], pa.int64()).cast(t) for k, (_, t) in enumerate(columns)], [n for n, _ in columns]), np.int64, 3)

    return found(seq)


def find_orfs(df: DataFrame, seq: str, starts: list[str], stops: list[str], min_length: int) -> DataFrame:
    """Rows of df by reading frame: start, end and offset are added."""
    small_batches(df.sparkSession)
    own = unused("_orfs", df)
    found = df.withColumn(own, open_reading_frames(F.col(seq), starts, stops, min_length))
    # inline alone would have the function run twice, once for a filter on its arrays
    names = {unused(f"_{n}", df): n for n in ("start", "end", "offset")}
    rows = found.select(*df.columns, F.inline_outer(own).alias(*names)).where(F.col(next(iter(names))).isNotNull())
    return rows.select(*df.columns, *(F.col(c).alias(n) for c, n in names.items()))
