"""FLAG bits, CIGAR strings, optional fields and packed bases of alignment records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the FLAG bits from the lowest on; CIGAR operations by code; packed bases by code.
FLAGS = (
    "paired proper_pair unmapped mate_unmapped reverse mate_reverse read1 read2 secondary qc_fail duplicate supplementary".split()
)
CIGAR_OPS = "MIDNSHP=XB"
CONSUME_QUERY, CONSUME_REFERENCE = ("M", "I", "S", "=", "X"), ("M", "D", "N", "=", "X")
PACKED_BASES = "=ACMGRSVTWYHKDBN"
U32 = 2**32 - 1


def flags(flag: Column) -> Column:
    """A struct of twelve booleans."""
    return F.struct(*((flag.bitwiseAND(1 << k) != 0).alias(name) for k, name in enumerate(FLAGS)))


def flag_value(bits: Column) -> Column:
    """The way back; higher bits are gone."""
    out = F.lit(0)
    for k, name in enumerate(FLAGS):
        out = out + F.when(bits[name], 1 << k).otherwise(0)
    return out


def cigar_code(op: Column) -> Column:
    at = F.instr(F.lit(CIGAR_OPS), op)
    return F.when((F.length(op) == 1) & (at > 0), at - 1)


def cigar_op(code: Column) -> Column:
    return F.when((code >= 0) & (code < len(CIGAR_OPS)), F.substring(F.lit(CIGAR_OPS), code + 1, F.lit(1)))


def cigar(text: Column) -> Column:
    """An array of (op, len); empty for ``*`` and the empty text, an error for a malformed one."""
    one = f"([0-9]+)([{CIGAR_OPS}])"
    length, op = F.regexp_extract_all(text, F.lit(one), 1), F.regexp_extract_all(text, F.lit(one), 2)
    pairs = F.zip_with(length, op, lambda n, o: F.struct(o.alias("op"), n.cast("long").alias("len")))
    good = text.rlike(f"^([0-9]+[{CIGAR_OPS}])+$") & ~F.exists(pairs, lambda p: p["len"] > U32)
    kind = "array<struct<op: string, len: bigint>>"
    return F.when(text.isin("*", ""), F.array().cast(kind)).when(good, pairs.cast(kind)).when(text.isNotNull(), F.raise_error(F.concat(F.lit("bad CIGAR: "), text)).cast(kind))


def consumes_query(op: Column) -> Column:
    return op.isin(*CONSUME_QUERY)


def consumes_reference(op: Column) -> Column:
    return op.isin(*CONSUME_REFERENCE)


def _span(ops: Column, consumes) -> Column:
    return F.aggregate(ops, F.lit(0).cast("long"), lambda n, o: n + F.when(consumes(o["op"]), o["len"]).otherwise(F.lit(0).cast("long")))


def query_length(ops: Column) -> Column:
    return _span(ops, consumes_query)


def reference_length(ops: Column) -> Column:
    return _span(ops, consumes_reference)


AUX = "array<struct<tag: string, type: string, c: string, i: bigint, f: float, s: string, h: string, sub: string, arr: array<string>>>"


def aux_fields(text: Column) -> Column:
    """Optional fields TAG:TYPE:VALUE, tab-separated: in each, the member for its type is set.

    Integer types (i I c C s S) fill ``i``; arrays keep their elements as text. Empty fields are
    skipped; a field of another shape is an error.
    """

    def parts(f: Column) -> Column:
        # lambdas share nothing among their columns, so what many of them need is made by one before
        kind, value = F.substring(f, 4, 1), F.substr(f, F.lit(6))
        shaped = f.rlike("(?s)^..:[AiIcCsSfZHB]:") & ((F.length(value) > 0) | kind.isin("Z", "H", "B"))
        return F.struct(f.alias("f"), kind.alias("kind"), value.alias("value"), shaped.alias("shaped"))

    def field(p: Column) -> Column:
        f, kind, value, shaped = (p[name] for name in ("f", "kind", "value", "shaped"))
        of = lambda *kinds: shaped & kind.isin(*kinds)
        return F.struct(
            F.when(shaped, F.substring(f, 1, 2)).otherwise(F.raise_error(F.concat(F.lit("bad optional field: "), f)).cast("string")).alias("tag"),
            kind.alias("type"),
            F.when(of("A"), value).alias("c"),
            F.when(of(*"iIcCsS"), value.cast("long")).alias("i"),
            F.when(of("f"), value.cast("float")).alias("f"),
            F.when(of("Z"), value).alias("s"),
            F.when(of("H"), value).alias("h"),
            F.when(of("B"), F.substring(value, 1, 1)).alias("sub"),
            F.when(of("B"), F.filter(F.split(F.substr(value, F.lit(3)), ","), lambda x: x != "")).alias("arr"),
        )

    return F.transform(F.transform(F.filter(F.split(text, "\t"), lambda f: f != ""), parts), field)


def aux_get(fields: Column, tag: str) -> Column:
    """The first field with the tag, or null."""
    return F.get(F.filter(fields, lambda f: f["tag"] == tag), F.lit(0))


def array_ints(field: Column) -> Column:
    return F.transform(field["arr"], lambda x: x.cast("long"))


def array_floats(field: Column) -> Column:
    return F.transform(field["arr"], lambda x: x.cast("float"))


def packed_bases(packed: Column, n: Column) -> Column:
    """Two bases a byte, the first in the high half."""
    return F.substring(F.translate(F.hex(packed), "0123456789ABCDEF", PACKED_BASES), F.lit(1), n.cast("int"))


def base_code(base: Column) -> Column:
    """Code of a base, either case; 15 for others."""
    at = F.instr(F.lit(PACKED_BASES), F.upper(base))
    return F.when((F.length(base) == 1) & (at > 0), at - 1).otherwise(15)


def quality_unavailable(quality: Column) -> Column:
    return F.startswith(F.hex(quality), F.lit("FF"))


def phred_at(quality: Column, i: Column) -> Column:
    """Phred score of base i (from 0) of a text of quality letters."""
    return F.ascii(F.substring(quality, i + 1, F.lit(1))) - 33
