"""Reference dictionary of a header, and its lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.columns import unused

#: Rows of a dictionary that is broadcast at most; a larger one is joined by shuffle.
BROADCAST_ROWS = 1_000_000


def by_name(refs: DataFrame) -> DataFrame:
    """(name, tid): the last entry of a repeated name."""
    return refs.groupBy("name").agg(F.max("tid").alias("tid"))


def resolve(alignments: DataFrame, refs: DataFrame) -> DataFrame:
    """alignments with tid and mtid: ordinals of rname and rnext; ``=`` is the own one, ``*`` and unknown names are -1."""
    names = by_name(refs)
    if refs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        names = F.broadcast(names)
    other = unused("_mate", alignments)
    own, mate = names.select(F.col("name").alias("rname"), "tid"), names.select(F.col("name").alias("rnext"), F.col("tid").alias(other))
    out = alignments.drop("tid", "mtid").join(own, "rname", "left").join(mate, "rnext", "left")
    tid = F.coalesce("tid", F.lit(-1))
    mtid = F.when(F.col("rnext") == "=", tid).otherwise(F.coalesce(other, F.lit(-1)))
    return out.withColumn("mtid", mtid).withColumn("tid", tid).drop(other)


def ref_name(names: Column, tid: Column) -> Column:
    """Name from an array by ordinal; null outside."""
    return F.when(tid >= 0, F.get(names, tid))


ref_length = ref_name
