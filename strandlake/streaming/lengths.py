"""Structured Streaming: length bins and base counts over a growing folder of sequences or events.

The bins of length_stats add up, so a stream keeps one small state row for each distinct length
(and window), and any statistic can be read from the sink with the batch operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.sources.sam import alignments


def length_bins_stream(stream: DataFrame, length: Column) -> DataFrame:
    """(length, n), for outputMode complete or update."""
    return stream.select(length.cast("long").alias("length")).where("length is not null").groupBy("length").agg(F.count("*").alias("n"))


def windowed_bins(stream: DataFrame, length: Column, at: str, window: str, late: str) -> DataFrame:
    """(window, length, n) by event time; rows later than ``late`` are not counted. For outputMode append."""
    rows = stream.select(F.col(at).alias("at"), length.cast("long").alias("length")).where("length is not null")
    return rows.withWatermark("at", late).groupBy(F.window("at", window), "length").agg(F.count("*").alias("n"))


def sam_stream(spark: SparkSession, path: str) -> DataFrame:
    """Alignment rows of SAM files as they arrive in a folder; header lines are left out, ordinals to the caller."""
    lines = spark.readStream.text(path).where("not (value like '@%' and value rlike '^@[A-Z][A-Z](\\\\t|$)')")
    return alignments(lines)
