"""SQL names for the functions: after ``register(spark)`` they can be called in any query."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DataType, IntegerType, LongType, StructField, StructType

from strandlake.functions.alignment_fields import CIGAR_OPS
from strandlake.functions.alphabet import COMPLEMENT
from strandlake.operators import fulltext, orf

_FROM, _TO = COMPLEMENT["dna"]
FUNCTIONS = {
    "dna_complement(s STRING) RETURNS STRING": f"translate(s, '{_FROM}', '{_TO}')",
    "dna_revcomp(s STRING) RETURNS STRING": f"reverse(translate(s, '{_FROM}', '{_TO}'))",
    "gc_count(s STRING) RETURNS INT": "length(s) - length(translate(s, 'GCgc', ''))",
    "phred_error(q INT) RETURNS DOUBLE": "pow(10D, -q / 10D)",
    "cigar_query_length(c STRING) RETURNS BIGINT": f"aggregate(filter(regexp_extract_all(c, '([0-9]+[{CIGAR_OPS}])', 1), x -> right(x, 1) IN ('M', 'I', 'S', '=', 'X')), 0L, (a, x) -> a + CAST(left(x, length(x) - 1) AS BIGINT))",
    "cigar_reference_length(c STRING) RETURNS BIGINT": f"aggregate(filter(regexp_extract_all(c, '([0-9]+[{CIGAR_OPS}])', 1), x -> right(x, 1) IN ('M', 'D', 'N', '=', 'X')), 0L, (a, x) -> a + CAST(left(x, length(x) - 1) AS BIGINT))",
    "bounded_levenshtein(a STRING, b STRING, k INT) RETURNS INT": "nullif(levenshtein(a, b, k), -1)",
}


def _row(**columns: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns.items()])


@udtf(returnType=_row(start=LongType(), end=LongType(), offset=IntegerType()))
class ReadingFrames:
    """reading_frames(seq, starts, stops, min_length); codons are joined by commas."""

    def eval(self, seq: str, starts: str, stops: str, min_length: int):
        if seq is not None:
            first, last = starts.split(","), stops.split(",")
            yield from orf.scan(seq, orf.codon_pattern(first, last), frozenset(first), frozenset(last), min_length)


@udtf(returnType=_row(position=LongType()))
class Matches:
    """matches(text, pattern): all overlapping positions."""

    def eval(self, text: str, pattern: str):
        if not pattern:
            raise ValueError("an empty pattern matches nowhere")
        at = -1 if text is None else text.find(pattern)
        while at >= 0:
            yield (at,)
            at = text.find(pattern, at + 1)


@udtf(returnType=_row(position=LongType(), qgram=LongType()))
class QGrams:
    """qgrams(text, letters, q): packed q-grams from left to right."""

    def eval(self, text: str, letters: str, q: int):
        ranks = {c: k for k, c in enumerate(sorted(set(letters)))}
        width = max(len(ranks) - 1, 0).bit_length()
        if q < 1 or q * width > 64:
            raise ValueError("q-grams need 1 to 64 bits")
        gram, mask = 0, (1 << q * width) - 1
        for k, c in enumerate(text or ""):
            gram = (gram << width | ranks[c]) & mask
            if k >= q - 1:
                yield k - q + 1, gram - (1 << 64 if gram >> 63 else 0)


def register(spark: SparkSession) -> None:
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    for name, table in (("reading_frames", ReadingFrames), ("matches", Matches), ("qgrams", QGrams)):
        spark.udtf.register(name, table)
    for name in ("suffix_array", "lcp", "bwt_find", "invert_bwt"):
        spark.udf.register(name, getattr(fulltext, name))
