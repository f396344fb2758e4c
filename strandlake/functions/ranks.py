"""Rank transform, q-grams and fixed-width bit packing as columns.

Ranks and packed blocks are made by Arrow functions, all values of a batch at once; lambdas cost a hundred times as much for each letter.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

from .columns import list_array

@dataclass(frozen=True)
class RankTransform:
    """Ranks of the distinct letters of ``symbols``, by code."""

    symbols: str

    @property
    def alphabet(self) -> str:
        return "".join(sorted(set(self.symbols)))

    @property
    def width(self) -> int:
        """Bits a rank takes; 0 for one letter or none."""
        n = len(self.alphabet)
        return ceil(log2(n)) if n > 1 else 0

    def rank(self, c: Column) -> Column:
        """An error for a letter that isn't in the alphabet."""
        at = F.instr(F.lit(self.alphabet), c)
        return F.when(at > 0, at - 1).when(c.isNotNull(), F.raise_error(F.concat(F.lit("no rank for "), c)).cast("int"))

    def transform(self, text: Column) -> Column:
        """An array of the ranks of a text's letters."""
        codes = np.array([ord(c) for c in self.alphabet], np.uint32)

        @F.arrow_udf(ArrayType(IntegerType()))
        def ranks(texts: pa.Array) -> pa.Array:
            rows = [None if t is None else np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (v.as_py() for v in texts)]

            def found(letters: np.ndarray) -> pa.Array:
                rank = np.searchsorted(codes, letters).astype(np.int32)
                wrong = codes[np.minimum(rank, len(codes) - 1)] != letters if len(codes) else np.ones(len(letters), bool)
                if wrong.any():
                    raise ValueError(f"no rank for {chr(letters[wrong.argmax()])}")
                return pa.array(rank)

            return list_array(rows, found, np.uint32)

        return ranks(text)

    def _letters(self, text: Column) -> Column:
        """``transform`` as an expression, which may stand in lambdas; for short texts."""
        letters = F.when(F.length(text) > 0, F.split(text, "")).when(text.isNotNull(), F.array().cast("array<string>"))
        return F.transform(letters, self.rank)

    def qgrams(self, q: int, text: Column) -> Column:
        """Packed q-grams from left to right; none for a shorter text. 64-bit patterns may be negative."""
        if q < 1 or q * self.width > 64:
            raise ValueError("q-grams need 1 to 64 bits")
        return self.packed(q, self._letters(text))

    def packed(self, q: int, ranks: Column) -> Column:
        """The q-grams of an array of ranks. For long texts the ranks should be a column of their own, so that they are made once."""
        w = self.width
        n = F.size(ranks) - q + 1
        at = F.when(n >= 1, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).when(ranks.isNotNull(), F.array().cast("array<int>"))
        get = lambda p, j: F.shiftleft(F.get(ranks, p - 1 + j).cast("long"), w * (q - 1 - j))

        def gram(p: Column) -> Column:
            out = get(p, 0)
            for j in range(1, q):
                out = out.bitwiseOR(get(p, j))
            return out

        return F.transform(at, gram)


#: Bits of a q-gram that are counted in an array by a task; longer ones are counted by sorting, so many at a time.
COUNTED_BITS, SORTED = 20, 1 << 22


def qgram_counts(df: DataFrame, text: str, ranks: RankTransform, q: int) -> DataFrame:
    """(qgram, n): how often each packed q-gram is in the texts. Tasks count before anything moves, and no q-gram becomes a row.

    Null texts have none; a letter outside the alphabet is an error. The q-grams are those of ``RankTransform.qgrams``.
    """
    if q < 1 or q * ranks.width > 64:
        raise ValueError("q-grams need 1 to 64 bits")
    alphabet, width = ranks.alphabet, ranks.width

    def rows(batches):
        codes = np.array([ord(c) for c in alphabet], np.uint32)
        counted = q * width <= COUNTED_BITS
        total = np.zeros(1 << q * width if counted else 0, np.int64)
        held, size = [], 0

        def sent(grams, n):
            return pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))], names=["qgram", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t is None or len(t) < q:
                    continue
                letters = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
                rank = np.searchsorted(codes, letters)
                if (codes[np.minimum(rank, len(codes) - 1)] != letters).any():
                    raise ValueError("a letter has no rank")
                grams = np.zeros(len(t) - q + 1, np.uint64)
                for j in range(q):
                    grams = (grams << np.uint64(width)) | rank[j : j + len(grams)].astype(np.uint64)
                if counted:
                    total += np.bincount(grams.astype(np.int64), minlength=len(total))
                    continue
                held.append(grams)
                size += len(grams)
                if size >= SORTED:
                    yield sent(*np.unique(np.concatenate(held), return_counts=True))
                    held, size = [], 0
        if held:
            yield sent(*np.unique(np.concatenate(held), return_counts=True))
        found = np.flatnonzero(total).astype(np.uint64)
        if len(found):
            yield sent(found, total[found.astype(np.int64)])

    return df.select(text).mapInArrow(rows, "qgram long, n long").groupBy("qgram").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class BitEncoding:
    """Values of 1 to 8 bits in 32-bit blocks (as longs); values are always masked to the width."""

    width: int

    def __post_init__(self):
        if not 1 <= self.width <= 8:
            raise ValueError("width must be 1 to 8")

    @property
    def per_block(self) -> int:
        return 32 // self.width

    @property
    def mask(self) -> int:
        return (1 << self.width) - 1

    def pack(self, values: Column) -> Column:
        """Blocks; one with a null among its values is null."""
        per, w, mask = self.per_block, self.width, self.mask

        @F.arrow_udf(ArrayType(LongType()))
        def blocks(lists: pa.Array) -> pa.Array:
            sizes, flat, known = _flat(lists)
            own = -(-sizes // per)
            to = _places(sizes, _starts(own) * per)
            padded, whole = np.zeros(own.sum() * per, np.int64), np.ones(own.sum() * per, bool)
            padded[to], whole[to] = flat & mask, known
            made = np.bitwise_or.reduce(padded.reshape(-1, per) << np.arange(per) * w, axis=1)
            return _lists(own, made, whole.reshape(-1, per).all(axis=1), lists.is_null())

        return blocks(values)

    def push(self, values: Column, value: Column, times: Column) -> Column:
        """values (unpacked) with value added so many times."""
        return F.concat(values, F.array_repeat(value, times))

    def get(self, blocks: Column, size: Column, i: Column) -> Column:
        """Value i; null out of range."""
        per = self.per_block
        block = F.get(blocks, F.floor(i / per).cast("int"))
        value = F.call_function("shiftright", block, ((i % per) * self.width).cast("int")).bitwiseAND(F.lit(self.mask).cast("long"))
        return F.when((i >= 0) & (i < size), value)

    def set(self, blocks: Column, size: Column, i: Column, value: Column) -> Column:
        """Blocks with value i replaced."""
        return self.pack(F.transform(self.unpack(blocks, size), lambda v, k: F.when(k == i, value.cast("long")).otherwise(v)))

    def unpack(self, blocks: Column, size: Column) -> Column:
        """The first values, so many; null beyond the blocks and in null blocks."""
        per, w, mask = self.per_block, self.width, self.mask

        @F.arrow_udf(ArrayType(LongType()))
        def values(lists: pa.Array, size: pa.Array) -> pa.Array:
            have, flat, known = _flat(lists)
            sizes = np.maximum(size.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False), 0)
            i = _places(sizes, np.zeros(len(sizes), np.int64))
            at, there = i // per + np.repeat(_starts(have), sizes), i // per < np.repeat(have, sizes)
            at = np.where(there, at, 0)
            if not len(flat):
                flat, known = np.zeros(1, np.int64), np.zeros(1, bool)
            return _lists(sizes, flat[at] >> i % per * w & mask, there & known[at], size.is_null())

        return values(blocks, size)

    def blocks_for(self, size: Column) -> Column:
        return F.ceil(size / self.per_block).cast("long")


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of lists (0 for null), their values put together as 64-bit numbers, and which of those aren't null."""
    sizes = lists.value_lengths().cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
    values = lists.flatten().cast(pa.int64())
    return sizes, values.fill_null(0).to_numpy(zero_copy_only=False), values.is_valid().to_numpy(zero_copy_only=False)


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _places(sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For the values of all lists: the start given for their list, plus their place in it."""
    return np.arange(sizes.sum()) + np.repeat(starts - _starts(sizes), sizes)


def _lists(sizes: np.ndarray, values: np.ndarray, known: np.ndarray, missing: pa.Array) -> pa.Array:
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(values, pa.int64(), mask=None if known.all() else ~known), mask=missing)
