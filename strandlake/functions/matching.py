"""Exact pattern matching: one operator, all overlapping 0-based positions ascending.

The classic automata differ in cost only, so they share the operator; their tables are given by
plain functions for study. An empty pattern is an error.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .columns import list_array, small_batches, unused


def contains(text: Column, pattern: str) -> Column:
    """Whether there is any match; no positions are made."""
    return F.contains(text, F.lit(_checked(pattern)))


def _checked(pattern: str) -> str:
    if not pattern:
        raise ValueError("an empty pattern matches nowhere")
    return pattern


def count(text: Column, pattern: str) -> Column:
    """Overlapping matches, without positions."""
    return F.regexp_count(text, F.lit(f"(?=\\Q{_checked(pattern)}\\E)"))


def find_all(text: Column, pattern: str) -> Column:
    """An array of positions; empty without a match, null for a null text.

    Positions come from an Arrow function, in time linear in the text: built-in substrings count
    letters from the start each time. Only texts that contain the pattern get there with their letters.
    """
    _checked(pattern)

    @F.arrow_udf(ArrayType(IntegerType()))
    def positions(texts: pa.Array) -> pa.Array:
        rows = [None if t is None else _positions(t, pattern) for t in (v.as_py() for v in texts)]
        return list_array(rows, lambda found: pa.array(found, pa.int32()), np.int32)

    return positions(F.when(contains(text, pattern), text).when(text.isNotNull(), ""))


def _positions(text: str, pattern: str) -> np.ndarray:
    """As numbers of four bytes, so that long texts with many matches stay small."""
    out, at = array("i"), text.find(pattern)
    while at >= 0:
        out.append(at)
        at = text.find(pattern, at + 1)
    return np.frombuffer(out, np.int32)


def find_patterns(df: DataFrame, text: str, patterns: list[str]) -> DataFrame:
    """df's rows by match: pattern and position are added. One pass over the texts for all patterns; a text goes to the function once."""
    kinds = [*map(_checked, patterns)]

    @F.arrow_udf(ArrayType(StructType([StructField("kind", IntegerType()), StructField("position", IntegerType())])))
    def matches(texts: pa.Array) -> pa.Array:
        def one(t):
            found = [_positions(t, p) for p in kinds]
            return np.stack([np.repeat(np.arange(len(found), dtype=np.int32), [len(x) for x in found]), np.concatenate(found)], 1)

        rows = [None if t is None else one(t) for t in (v.as_py() for v in texts)]
        return list_array(rows, lambda m: pa.StructArray.from_arrays([pa.array(m[:, k], pa.int32()) for k in (0, 1)], ["kind", "position"]), np.int32, 2)

    small_batches(df.sparkSession)
    t, own, kind, place = F.col(text), *(unused(name, df) for name in ("_found", "_kind", "_place"))
    some = F.lit(False)
    for p in kinds:
        some = some | contains(t, p)
    found = df.withColumn(own, matches(F.when(some, t)))
    # inline alone would have the function run twice, once for a filter on its arrays
    rows = found.select(*df.columns, F.inline_outer(own).alias(kind, place)).where(F.col(kind).isNotNull())
    return rows.select(*df.columns, F.get(F.array(*map(F.lit, kinds)), F.col(kind)).alias("pattern"), F.col(place).alias("position"))


def kmp_borders(pattern: str) -> list[int]:
    """For each prefix the length of its longest proper border."""
    out = [0] * len(_checked(pattern))
    for i in range(1, len(pattern)):
        k = out[i - 1]
        while k and pattern[k] != pattern[i]:
            k = out[k - 1]
        out[i] = k + (pattern[k] == pattern[i])
    return out


def kmp_delta(pattern: str, state: int, letter: str) -> int:
    """State after reading a letter; the last state is the whole pattern."""
    borders = kmp_borders(pattern)
    while state == len(pattern) or state and pattern[state] != letter:
        state = borders[state - 1]
    return state + (pattern[state] == letter)


def horspool_shifts(pattern: str) -> dict[str, int]:
    """Shift for each letter of the pattern but the last place; others shift by the whole length."""
    return {c: len(pattern) - 1 - i for i, c in enumerate(_checked(pattern)[:-1])}


def shift_and_masks(pattern: str) -> tuple[dict[str, int], int]:
    """Bit masks by letter and the accepting bit."""
    masks: dict[str, int] = {}
    for i, c in enumerate(_checked(pattern)):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks, 1 << len(pattern) - 1


def bndm_masks(pattern: str) -> tuple[dict[str, int], int]:
    return shift_and_masks(_checked(pattern)[::-1])


def factor_oracle(pattern: str) -> list[dict[str, int]]:
    """Transitions of the factor oracle of the reversed pattern."""
    word = _checked(pattern)[::-1]
    edges: list[dict[str, int]] = [{}]
    supply = [-1]
    for i, c in enumerate(word):
        edges[i][c] = i + 1
        edges.append({})
        k = supply[i]
        while k >= 0 and c not in edges[k]:
            edges[k][c] = i + 1
            k = supply[k]
        supply.append(0 if k < 0 else edges[k][c])
    return edges
