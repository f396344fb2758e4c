"""Length statistics: N50, L50, NX, quartiles and moments of sequence lengths.

Everything starts from the bins (length, n): one partial and one final hash aggregation over the
input. All later steps work on the bins, of which there are as many as distinct lengths, so no
sequence is sorted. Order statistics come from cumulative counts of the bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def length_bins(df: DataFrame, length: Column, by: list[str] = ()) -> DataFrame:
    """(by..., length, n, seen): sequences by length, and how many are as short or shorter."""
    w = Window.partitionBy(*by).orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    bins = df.select(*by, length.cast("long").alias("length")).where("length is not null").groupBy(*by, "length").agg(F.count("*").alias("n"))
    return bins.withColumn("seen", F.sum("n").over(w))


def _value_at(rank: Column) -> Column:
    """The length with that rank (from 1) among all sequences, as an aggregate over bins."""
    return F.min(F.when(F.col("seen") >= rank, F.col("length")))


def _middle(first: Column, n: Column) -> Column:
    """Median of the n sequences that follow the first ones."""
    low, high = first + F.floor((n + 1) / 2), first + F.floor((n + 2) / 2)
    return (_value_at(low) + _value_at(high)) / F.lit(2.0)


def length_stats(df: DataFrame, length: Column, by: list[str] = (), nx: tuple[int, ...] = (90,)) -> DataFrame:
    """One row (for each group): count, sum, min, max, mean, q1, q2, q3, n50, l50, and nXX.

    Quartiles are medians of the lower and upper ceil(n / 2) sequences. l50 counts distinct lengths, from the
    longest, until half of all letters are reached. Without sequences everything is 0 (a row only
    without ``by``).
    """
    by = list(by)
    w = Window.partitionBy(*by)
    longest = w.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    bins = length_bins(df, length, by).withColumns(
        {
            "total": F.sum("n").over(w),
            "letters": F.sum(F.col("n") * F.col("length")).over(w),
            "above": F.sum(F.col("n") * F.col("length")).over(longest),
            "place": F.row_number().over(longest),
        }
    )
    total, half = F.col("total"), F.floor((F.col("total") + 1) / 2)

    def reached(x: int) -> Column:
        return F.col("above") >= F.col("letters") * (x / 100.0)

    zero = F.lit(0).cast("long")
    return bins.groupBy(*by).agg(
        F.coalesce(F.sum("n"), zero).alias("count"),
        F.coalesce(F.sum(F.col("n") * F.col("length")), zero).alias("sum"),
        F.coalesce(F.min("length"), zero).alias("min"),
        F.coalesce(F.max("length"), zero).alias("max"),
        F.coalesce(F.sum(F.col("n") * F.col("length")) / F.sum("n"), F.lit(0.0)).alias("mean"),
        F.coalesce(_middle(zero, half), F.lit(0.0)).alias("q1"),
        F.coalesce(_middle(zero, total), F.lit(0.0)).alias("q2"),
        F.coalesce(_middle(F.floor(total / 2), half), F.lit(0.0)).alias("q3"),
        F.coalesce(F.max(F.when(reached(50), F.col("length"))), zero).alias("n50"),
        F.coalesce(F.min(F.when(reached(50), F.col("place"))), F.lit(0)).cast("long").alias("l50"),
        *(F.coalesce(F.max(F.when(reached(x), F.col("length"))), zero).alias(f"n{x}") for x in nx if x != 50),
    )
