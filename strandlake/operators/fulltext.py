"""Full-text index of many texts: suffix array, LCP, BWT, less, Occ and backward search.

Each text is one row and its index columns are arrays. Suffixes are sorted inside the row by
doubling (three array passes a round), texts are spread over the cluster, and no shuffle
happens. For a single text that is too long for a row, ``suffix_array_rows`` does the doubling with
rows and range-partitioned sorts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

#: A type object: workers import this module without a session that could parse a name.
LONGS = ArrayType(LongType())


def _order(ranks: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling on integer ranks."""
    rank = np.unique(ranks, return_inverse=True)[1].astype(np.int64)
    n, k = len(rank), 1
    order = np.argsort(rank, kind="stable")
    while k < n and (rank[order][1:] == rank[order][:-1]).any():
        second = np.full(n, -1, np.int64)
        second[: n - k] = rank[k:]
        order = np.lexsort((second, rank))
        a, b = rank[order], second[order]
        new = np.concatenate(([0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        rank = np.empty(n, np.int64)
        rank[order] = new
        k *= 2
    return order


def _lcp(symbols: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefixes of neighbours in the order; -1 at both ends."""
    n = len(symbols)
    out = np.full(n + 1, -1, np.int64)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    h, s = 0, symbols.tolist()
    for i, r in enumerate(place.tolist()):
        if r:
            j = int(order[r - 1])
            while i + h < n and j + h < n and s[i + h] == s[j + h]:
                h += 1
            out[r] = h
            h = max(0, h - 1)
        else:
            h = 0
    return out


def _symbols(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


@F.pandas_udf(LONGS)
def suffix_array(text: pd.Series) -> pd.Series:
    """Start positions (bytes) of the suffixes in order. The text should end with a unique smallest letter."""
    return text.map(lambda t: None if t is None else _order(_symbols(t)))


@F.pandas_udf(LONGS)
def suffix_array_ints(ranks: pd.Series) -> pd.Series:
    """The same for an array of non-negative numbers."""
    return ranks.map(lambda r: None if r is None else _order(np.asarray(r, np.int64)))


@F.pandas_udf(LONGS)
def lcp(text: pd.Series, sa: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else _lcp(_symbols(t), np.asarray(p)) for t, p in zip(text, sa)])


@F.pandas_udf(StringType())
def bwt(text: pd.Series, sa: pd.Series) -> pd.Series:
    """The letter before each suffix, the last one for the first (texts of one byte a letter)."""
    return pd.Series([None if t is None or p is None else _symbols(t)[np.asarray(p, np.int64) - 1].tobytes().decode("utf-8", "replace") for t, p in zip(text, sa)])


def less(bwt_text: Column) -> Column:
    """For each code c from 0 to the largest + 1: how many letters have a smaller code."""
    codes = F.transform(F.filter(F.split(bwt_text, ""), lambda c: c != ""), lambda c: F.ascii(c))
    top = F.coalesce(F.array_max(codes), F.lit(-1)) + 1
    return F.transform(F.sequence(F.lit(0), top), lambda c: F.size(F.filter(codes, lambda x: x < c)).cast("long"))


def occ(bwt_text: Column, r: Column, letter: Column) -> Column:
    """How often the letter is in bwt[0..r]."""
    head = F.substring(bwt_text, F.lit(1), (r + 1).cast("int"))
    return (F.length(head) - F.length(F.replace(head, letter, F.lit("")))).cast("long")


def occ_checkpoints(df: DataFrame, key: str, bwt_text: str, every: int) -> DataFrame:
    """(key, r, letter, n): counts at every so many rows only; ``n`` up to the next is counted from there."""
    rows = df.select(key, F.posexplode(F.filter(F.split(bwt_text, ""), lambda c: c != "")).alias("r", "letter"))
    w = Window.partitionBy(key, "letter").orderBy("r")
    letters = rows.select(key, "letter").distinct()
    marks = rows.where(F.col("r") % every == 0).select(key, "r")
    return marks.join(letters, key).join(rows.withColumn("k", F.row_number().over(w)).withColumnRenamed("r", "at"), [key, "letter"]).where("at <= r").groupBy(key, "r", "letter").agg(F.max("k").cast("long").alias("n"))


@F.pandas_udf(LONGS)
def bwt_find(text: pd.Series) -> pd.Series:
    """For each place in the sorted letters where that letter is in the BWT."""
    return text.map(lambda b: None if b is None else np.argsort(_symbols(b), kind="stable"))


@F.pandas_udf(StringType())
def invert_bwt(text: pd.Series) -> pd.Series:
    """The text, from the BWT of a text that ends with a unique smallest letter."""

    def one(b: str | None) -> str | None:
        if not b:
            return b
        s = _symbols(b)
        to, out = np.argsort(s, kind="stable").tolist(), []
        r = to[0]
        for _ in range(len(s)):
            r = to[r]
            out.append(s[r])
        return bytes(out).decode("utf-8", "replace")

    return text.map(one)


class Sampled:
    """less, and Occ at every ``EVERY``-th row; a count in between is taken from the rows after the last sample."""

    EVERY = 128

    def __init__(self, bwt_text: str):
        self.symbols = _symbols(bwt_text)
        counts = np.bincount(self.symbols, minlength=256)
        self.less = np.concatenate(([0], np.cumsum(counts)))
        self.samples: dict[int, np.ndarray] = {}

    def occ(self, code: int, rows: int) -> int:
        """How often the letter is in the first so many rows."""
        marks = self.samples.get(code)
        if marks is None:
            hits = np.add.reduceat(self.symbols == code, np.arange(0, len(self.symbols), self.EVERY), dtype=np.int64) if len(self.symbols) else np.zeros(0, np.int64)
            marks = self.samples[code] = np.concatenate(([0], np.cumsum(hits)))
        k = rows // self.EVERY
        return int(marks[k] + np.count_nonzero(self.symbols[k * self.EVERY : rows] == code))

    def search(self, pattern: str) -> tuple[str, int | None, int | None, int | None]:
        low, high, done = 0, len(self.symbols), 0
        codes = pattern.encode("utf-8", "surrogatepass")
        for code in reversed(codes):
            a, b = (int(self.less[code]) + self.occ(code, r) for r in (low, high))
            if a >= b:
                break
            low, high, done = a, b, done + 1
        if not done:
            return "absent", None, None, None
        return ("complete", low, high, None) if done == len(codes) else ("partial", low, high, done)


HIT = StructType([StructField("kind", StringType()), StructField("lower", LongType()), StructField("upper", LongType()), StructField("len", IntegerType())])


@F.pandas_udf(HIT)
def backward_search(bwt_text: pd.Series, pattern: pd.Series) -> pd.DataFrame:
    """struct(kind, lower, upper, len): rows [lower, upper) of the suffix array that begin with the pattern (texts of one byte a letter).

    ``complete``; ``partial``: only the last len letters occur, with their rows; ``absent``: not even the last
    letter, or an empty pattern. The sampled counts of a text are made once for patterns that follow one another.
    """
    last, index, out = None, None, []
    for b, p in zip(bwt_text, pattern):
        if b is None or p is None:
            out.append((None, None, None, None))
            continue
        if index is None or b != last:
            last, index = b, Sampled(b)
        out.append(index.search(p))
    found = pd.DataFrame(out, columns=["kind", "lower", "upper", "len"], dtype=object)
    return found.astype({"lower": "Int64", "upper": "Int64", "len": "Int32"})


def occurrences(sa: Column, interval: Column) -> Column:
    """Positions of an interval, in suffix-array order."""
    return F.when(interval["lower"].isNotNull(), F.slice(sa, (interval["lower"] + 1).cast("int"), (interval["upper"] - interval["lower"]).cast("int")))


def suffix_array_rows(letters: DataFrame) -> DataFrame:
    """(pos, rank) from (pos, rank) of one text of any length: doubling with rows.

    Ranks after each round are counted over range-sorted partitions, so no task holds the text;
    each round is stored.
    """
    from strandlake.operators.stored import stored

    n, k = letters.count(), 1
    state = stored(letters.select(F.col("pos").cast("long"), F.col("rank").cast("long")))
    while True:
        ahead = state.select((F.col("pos") - k).alias("pos"), F.col("rank").alias("next"))
        pairs = state.join(ahead, "pos", "left").select("pos", "rank", F.coalesce("next", F.lit(-1).cast("long")).alias("next"))
        classes = pairs.groupBy("rank", "next").agg(F.count("*").alias("n"))
        ranked = _running(classes)
        state = stored(pairs.join(ranked, ["rank", "next"]).select("pos", F.col("before").alias("rank")))
        k *= 2
        if k >= n or classes.count() == n:
            return state


def _running(classes: DataFrame) -> DataFrame:
    """For each (rank, next) in order how many rows come before: a sum over each range partition, then offsets."""
    from strandlake.operators.stored import stored

    ordered = stored(classes.repartitionByRange("rank", "next").withColumn("part", F.spark_partition_id()))
    sums = ordered.groupBy("part").agg(F.sum("n").alias("all"))  # as many rows as partitions
    offsets = sums.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("offset"))
    inner = Window.partitionBy("part").orderBy("rank", "next")
    return ordered.withColumn("own", F.sum("n").over(inner) - F.col("n")).join(F.broadcast(offsets), "part").select("rank", "next", (F.col("own") + F.col("offset")).alias("before"))
