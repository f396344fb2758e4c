"""What the operators of this package share: tables, stored intermediate results, word shingles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.columns import small_batches, unused
from strandlake.operators.stored import delete, fresh, mark, release, shared_dir, stored  # noqa: F401

#: White space of every contract here: space and the control characters 9 to 13.
SPACE = "\\x20\\x09-\\x0D"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Stored tables that go when the block ends; what a result still needs has to be stored by ``stored``."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []
        small_batches(spark)

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path, schema = fresh(self.spark, name), df.schema
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            delete(self.spark, path)
        self.paths = []


def succeeded(df: DataFrame, name: str, since: int) -> DataFrame:
    """df stored; then all that was stored since that mark goes, since only df needed it."""
    out = stored(df, name)
    release(df.sparkSession, since, but=1)
    return out


def in_fold(doc_id: Column) -> Column:
    """True for held-out rows: crc32 of doc_id as text, mod 5, is 0. A null doc_id is never held out nor learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def may_learn(doc_id: Column) -> Column:
    return doc_id.isNotNull() & ~in_fold(doc_id)


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


#: Bytes of a table that is broadcast at most, as it lies in memory.
BROADCAST_BYTES = 64 << 20
#: Rows of one key that a join handles in one part, and keys that are split, at most.
PART_ROWS, HOT_KEYS = 100_000, 100_000


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it takes at most ``BROADCAST_BYTES``; as it is otherwise, for a shuffled join.

    df should be a stored table of columns of fixed width (8 bytes each, and about 40 for a row's place in the hash table);
    others have no known size and aren't broadcast by this.
    """
    kinds = {f.dataType.typeName() for f in df.schema.fields}
    if not kinds <= {"long", "integer", "short", "byte", "boolean", "double", "float"}:
        return df
    rows = BROADCAST_BYTES // (40 + 8 * len(df.columns))
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def split_join(many: DataFrame, one: DataFrame, keys: list[str], n: str, spread: str) -> DataFrame:
    """many joined with one, which has a row for each key and a column n of how many rows many has of it at most.

    Keys of very many rows are split by a hash of the column spread, so that no task gets them all. They are
    ``HOT_KEYS`` at most, whatever the size, and so can be broadcast. one should be a stored table.
    """
    total, top = one.agg(F.sum(n), F.max(n)).first()
    least = max(PART_ROWS, -(-(total or 0) // HOT_KEYS))
    if (top or 0) <= least:
        return many.join(one, keys)
    size, part = unused("_parts", many, one), unused("_part", many, one)
    parts = F.ceil(F.col(n) / least).cast("long")
    hot = F.broadcast(one.where(F.col(n) > least).select(*keys, parts.alias(size)))
    left = many.join(hot, keys, "left").withColumn(part, F.coalesce(F.pmod(F.xxhash64(spread), F.col(size)), F.lit(0).cast("long"))).drop(size)
    right = one.withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    return left.join(right, [*keys, part]).drop(part)


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else unchanged, as the contracts ask."""
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())


def words(text: Column) -> Column:
    """Lower-cased words; none for a null text."""
    return F.filter(F.split(lowered(F.coalesce(text, F.lit(""))), f"[{SPACE}]+"), lambda w: w != "")
