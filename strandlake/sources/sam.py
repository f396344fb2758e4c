"""SAM text: header tables and alignment rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.alignment_fields import cigar, query_length
from strandlake.operators.dictionary import resolve

COLUMNS = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]
# What the header may say about order and grouping.
SORT_ORDERS, GROUP_ORDERS = ("unknown", "unsorted", "queryname", "coordinate"), ("none", "query", "reference")


class Header:
    """Header tables from a DataFrame of header lines (value, at), at giving their order."""

    def __init__(self, lines: DataFrame):
        fields = F.transform(
            F.filter(F.slice(F.split("value", "\t"), 2, 1_000_000), lambda f: (F.length(f) >= 3) & (F.substring(f, 3, 1) == ":")),
            lambda f: F.struct(F.substring(f, 1, 2).alias("key"), F.substr(f, F.lit(4)).alias("value")),
        )
        self.lines = lines.select("at", "value", F.substring("value", 1, 3).alias("kind"), fields.alias("tags"))

    def _of(self, kind: str) -> DataFrame:
        return self.lines.where(F.col("kind") == kind)

    def version(self) -> DataFrame:
        """(major, minor, sort_order, group_order, sub_sort): one row, with defaults where the header is silent."""

        def known(key: str, values: tuple[str, ...]) -> Column:
            v = tag("tags", key)
            return F.when(v.isNull(), values[0]).when(v.isin(*values), v).otherwise(F.raise_error(F.concat(F.lit(f"bad {key}: "), v)).cast("string"))

        vn = tag("tags", "VN")
        return self._of("@HD").select(
            F.split(vn, "\\.")[0].cast("int").alias("major"),
            F.split(vn, "\\.")[1].cast("int").alias("minor"),
            known("SO", SORT_ORDERS).alias("sort_order"),
            known("GO", GROUP_ORDERS).alias("group_order"),
            F.substring_index(tag("tags", "SS"), ":", 1).alias("sub_sort"),
        )

    def refs(self) -> DataFrame:
        """(tid, name, len): SN is needed; LN is 0 if absent. Repeated names stay.

        A dictionary is small beside the alignments, and its ordinals need one order.
        """
        from pyspark.sql import Window

        name = F.coalesce(tag("tags", "SN"), F.raise_error(F.lit("@SQ without SN")).cast("string"))
        size = F.coalesce(tag("tags", "LN").cast("bigint"), F.lit(0).cast("bigint"))
        return self._of("@SQ").select((F.row_number().over(Window.orderBy("at")) - 1).alias("tid"), name.alias("name"), size.alias("len"))

    def read_groups(self) -> DataFrame:
        return self._of("@RG").select("at", "tags")

    def programs(self) -> DataFrame:
        return self._of("@PG").select("at", "tags")

    def comments(self) -> DataFrame:
        return self._of("@CO").select("at", F.substr("value", F.lit(5)).alias("text"))


def tag(tags: str | Column, key: str) -> Column:
    """The first value of a key, or null."""
    return F.get(F.filter(tags, lambda t: t["key"] == key), F.lit(0))["value"]


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines without their ends, with a number that grows along each file."""
    return spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("value"), F.monotonically_increasing_id().alias("at"))


def read_header(spark: SparkSession, path: str) -> Header:
    return Header(_numbered(spark, path).where("value like '@%' and value rlike '^@[A-Z][A-Z](\\t|$)'"))


def alignments(lines: DataFrame) -> DataFrame:
    """COLUMNS and aux (text) of alignment lines (value). Fewer than 11 columns, or lengths that contradict, are errors."""
    cells = F.split("value", "\t")
    enough = F.when(F.size(cells) >= 11, cells).otherwise(F.raise_error(F.concat(F.lit("too few columns: "), F.col("value"))).cast("array<string>"))
    rows = lines.where("value <> ''").select(enough.alias("c"))
    kinds = dict(flag="int", pos="bigint", mapq="smallint", pnext="bigint", tlen="bigint")
    typed = rows.select(
        *(F.get("c", F.lit(k)).cast(kinds.get(name, "string")).alias(name) for k, name in enumerate(COLUMNS)),
        F.array_join(F.slice("c", 12, 1_000_000), "\t").alias("aux"),
    )
    star = lambda c: F.col(c) == "*"
    fits = (star("cigar") | star("seq") | (query_length(cigar(F.col("cigar"))) == F.length("seq"))) & (star("qual") | star("seq") | (F.length("qual") == F.length("seq")))
    checked = F.when(fits, F.col("seq")).otherwise(F.raise_error(F.concat(F.lit("lengths contradict in "), F.col("qname"))).cast("string"))
    return typed.withColumn("seq", checked).withColumns({c: F.when(star(c), "").otherwise(F.col(c)) for c in ("cigar", "seq", "qual")})


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment rows with tid and mtid from the file's own header."""
    rows = alignments(_numbered(spark, path).where("not (value like '@%' and value rlike '^@[A-Z][A-Z](\\t|$)')"))
    return resolve(rows, read_header(spark, path).refs())
