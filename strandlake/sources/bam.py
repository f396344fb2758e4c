"""BAM: binary alignments in BGZF blocks, as a source and as a sink.

A file is one task when read: its blocks are inflated one after another and records are cut from
the stream, so that memory holds a block and a record, not the file's contents. Written parts are whole BAM files, which
a task sends block by block through Spark's text writer: a block ends with the highest byte of its payload's length,
which is always 0, so that a line end of one zero byte after the rest of each block gives the block itself.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from strandlake.functions.alignment_fields import CIGAR_OPS, packed_bases

from . import bgzf
from .files import parsed

FIELDS = ["qname", "flag", "tid", "pos", "mapq", "mtid", "pnext", "tlen", "bin", "l_seq", "cigar", "seq_packed", "qual_raw", "aux_raw"]
SCHEMA = (
    "qname string, flag int, tid int, pos bigint, mapq smallint, mtid int, pnext bigint, tlen bigint, bin int, l_seq bigint, "
    "cigar string, seq_packed binary, qual_raw binary, aux_raw binary"
)
#: Scores as letters, and back.
_TO_LETTERS, _TO_SCORES = bytes((k + 33) % 256 for k in range(256)), bytes((k - 33) % 256 for k in range(256))
# Binary types of optional fields and of array elements.
NUMBERS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}


_NUMBER = {k: struct.Struct(form) for k, form in NUMBERS.items()}
_HEAD = struct.Struct("<iiBBHHHiiii")


class BamError(ValueError):
    pass


class Stream:
    """Bytes of the blocks, taken as needed."""

    def __init__(self, data):
        self.blocks, self.held, self.at = bgzf.blocks(data), b"", 0

    def _more(self) -> bool:
        """The next block behind what is held; False at the end."""
        more = next(self.blocks, None)
        if more is not None:
            self.held, self.at = self.held[self.at :] + more, 0
        return more is not None

    def take(self, n: int) -> bytes:
        while len(self.held) - self.at < n:
            if not self._more():
                raise BamError("the file ends inside a field")
        self.at += n
        return self.held[self.at - n : self.at]

    def ended(self) -> bool:
        while self.at == len(self.held):
            if not self._more():
                return True
        return False

    def number(self) -> int:
        return struct.unpack("<i", self.take(4))[0]


def header(stream: Stream) -> tuple[str, list[tuple[str, int]]]:
    """Header text, and the references of the binary list, which alone give ordinals."""
    if stream.take(4) != b"BAM\x01":
        raise BamError("not a BAM file")
    text = stream.take(stream.number()).rstrip(b"\0").decode()
    refs = []
    for _ in range(stream.number()):
        name = stream.take(stream.number()).rstrip(b"\0").decode()
        refs.append((name, stream.number()))
    return text, refs


@lru_cache(4096)
def packed_cigar(raw: bytes) -> str:
    """Operations of whole 4-byte entries: code in the low four bits, length above."""
    whole = struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4])
    return "".join(f"{v >> 4}{CIGAR_OPS[v & 15]}" for v in whole)


def record(raw: bytes) -> tuple:
    try:
        tid, pos, name, mapq, bin_, ops, flag, size, mtid, pnext, tlen = _HEAD.unpack_from(raw)
        at = 32 + name
        cigar, at = raw[at : at + 4 * ops], at + 4 * ops
        seq, at = raw[at : at + (size + 1) // 2], at + (size + 1) // 2
        qual, at = raw[at : at + size], at + size
    except struct.error as e:
        raise BamError(f"bad record: {e}") from e
    if at > len(raw):
        raise BamError("a record is shorter than its fields")
    return raw[32 : 31 + name].decode(), flag, tid, max(pos + 1, 0), mapq, mtid, max(pnext + 1, 0), tlen, bin_, size, packed_cigar(cigar), seq, qual, raw[at:]


def _records(data: bytes) -> Iterator[tuple]:
    stream = Stream(memoryview(data))
    header(stream)
    size = struct.Struct("<i").unpack_from
    while not stream.ended():
        # records that a block holds as a whole are cut from it without calls
        held, at = stream.held, stream.at
        while at + 4 <= len(held):
            end = at + 4 + size(held, at)[0]
            if end > len(held) or end < at + 4:
                break
            yield record(held[at + 4 : end])
            at = end
        stream.at = at
        if at < len(held):
            yield record(stream.take(stream.number()))


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    """FIELDS (packed fields as they are), with seq and qual decoded beside them. seq is only decoded where it is selected."""
    rows = parsed(spark, path, _records, SCHEMA).drop("path")
    return rows.select("*", packed_bases(F.col("seq_packed"), F.col("l_seq")).alias("seq"), quality_text("qual_raw").alias("qual"))


@F.arrow_udf(StringType())
def quality_text(raw: pa.Array) -> pa.Array:
    """Quality letters of packed scores; empty where there are none (a first byte of 255)."""
    return pa.array([None if b is None else "" if not b or b[0] == 255 else b.translate(_TO_LETTERS).decode("latin-1") for b in raw.to_pylist()], pa.string())


@F.arrow_udf(BinaryType())
def packed_quality(qual: pa.Array, n: pa.Array) -> pa.Array:
    """Packed scores of quality letters; without any, n bytes of 255."""
    rows = zip(qual.to_pylist(), n.to_pylist())
    return pa.array([None if q is None or k is None else q.encode("latin-1").translate(_TO_SCORES) if q else b"\xff" * int(k) for q, k in rows], pa.binary())


def read_bam_refs(spark: SparkSession, path: str) -> DataFrame:
    """(path, tid, name, len) and the header text on every row."""

    def refs(data: bytes):
        text, found = header(Stream(memoryview(data)))
        for tid, (name, size) in enumerate(found):
            yield tid, name, size, text

    return parsed(spark, path, refs, "tid int, name string, len bigint, text string")


@lru_cache(1024)
def _array(kind: str, n: int) -> struct.Struct:
    return struct.Struct(f"<{n}{NUMBERS[kind][1]}")


def aux_values(raw: bytes) -> Iterator[tuple[str, str, object]]:
    """(tag, type, value); arrays are (element type, numbers)."""
    at = 0
    try:
        while at < len(raw):
            tag, kind = raw[at : at + 2].decode(), chr(raw[at + 2])
            at += 3
            if kind == "A":
                value, at = chr(raw[at]), at + 1
            elif kind in _NUMBER:
                one = _NUMBER[kind]
                (value,) = one.unpack_from(raw, at)
                at += one.size
            elif kind in "ZH":
                end = raw.index(0, at)
                value, at = raw[at:end].decode(), end + 1
            elif kind == "B":
                one, n = chr(raw[at]), int.from_bytes(raw[at + 1 : at + 5], "little")
                if n * _NUMBER[one].size > len(raw):
                    raise BamError(f"{tag} is longer than its record")
                form = _array(one, n)
                value, at = (one, list(form.unpack_from(raw, at + 5))), at + 5 + form.size
            else:
                raise BamError(f"unknown type {kind!r} of {tag}")
            yield tag, kind, value
    except (struct.error, ValueError, IndexError, KeyError) as e:
        raise BamError(f"bad optional fields: {e}") from e


def aux_text(raw: bytes) -> str:
    """Optional fields as SAM writes them."""
    out = []
    for tag, kind, value in aux_values(raw):
        if kind == "B":
            value = ",".join([value[0], *(f"{v:g}" if value[0] == "f" else str(v) for v in value[1])])
        elif kind == "f":
            value = f"{value:g}"
        out.append(f"{tag}:{'i' if kind in 'cCsSI' else kind}:{value}")
    return "\t".join(out)


@F.arrow_udf(StringType())
def aux_as_text(raw: pa.Array) -> pa.Array:
    """Optional fields of packed rows as text, for the functions on text."""
    return pa.array([None if b is None else aux_text(b) for b in raw.to_pylist()], pa.string())


@lru_cache(4096)
def encode_cigar(text: str) -> bytes:
    """Packed operations of a CIGAR text."""
    ops = [int(n) << 4 | CIGAR_OPS.index(op) for n, op in re.findall(r"(\d+)(\D)", text)]
    return struct.pack(f"<{len(ops)}I", *ops)


def encode_record(qname, flag, tid, pos, mapq, mtid, pnext, tlen, bin_, l_seq, cigar, seq_packed, qual_raw, aux_raw) -> bytes:
    """A row of FIELDS as it is in a file; pos and pnext 0 are absent."""
    ops, name = encode_cigar(cigar or ""), (qname or "*").encode() + b"\0"
    size = 32 + len(name) + len(ops) + len(seq_packed) + len(qual_raw) + len(aux_raw)
    head = struct.pack("<iiiBBHHHiiii", size, tid, pos - 1, len(name), mapq, bin_, len(ops) // 4, flag, l_seq, mtid, pnext - 1, tlen)
    return b"".join((head, name, ops, seq_packed, qual_raw, aux_raw))


def encode_header(text: str, refs: list[tuple[str, int]]) -> bytes:
    t = text.encode()
    out = [b"BAM\x01", struct.pack("<i", len(t)), t, struct.pack("<i", len(refs))]
    for name, size in refs:
        raw = name.encode() + b"\0"
        out += [struct.pack("<i", len(raw)), raw, struct.pack("<i", size)]
    return b"".join(out)


def packed_rows(df: DataFrame) -> DataFrame:
    """FIELDS from rows with seq and qual as text and aux_raw or none: the packed columns are made."""
    code = F.translate(F.upper("seq"), "=ACMGRSVTWYHKDBN", "0123456789ABCDEF")
    packed = F.unhex(F.when(F.length("seq") % 2 == 1, F.concat(code, F.lit("0"))).otherwise(code))
    qual = packed_quality("qual", F.length("seq"))
    out = df.withColumns({"seq_packed": packed, "qual_raw": qual, "l_seq": F.length("seq").cast("long")})
    for name, value in (("bin", F.lit(0)), ("aux_raw", F.unhex(F.lit("")))):
        if name not in df.columns:
            out = out.withColumn(name, value)
    return out.select(*FIELDS)


def write_bam(df: DataFrame, path: str, text: str, refs: list[tuple[str, int]]) -> None:
    """One whole BAM file under path for each partition of df, in any store that Spark writes to.

    Rows keep their order inside a partition, and a task holds one block.
    """

    def run(batches):
        def sent(payload: bytes, last: bool = False):
            data = bgzf.deflate(payload, end=last)
            cuts = []
            at = 0
            while at < len(data):
                at += bgzf.block_size(data, at)[0]
                cuts.append(at)
            return pa.RecordBatch.from_arrays([pa.array([data[a : b - 1] for a, b in zip([0, *cuts], cuts)], pa.binary())], names=["block"])

        held = bytearray(encode_header(text, refs))
        for batch in batches:
            for r in zip(*(batch.column(k).to_pylist() for k in range(len(FIELDS)))):
                one = encode_record(*r)
                if len(held) + len(one) > bgzf.MAX_PAYLOAD:
                    yield sent(bytes(held))
                    held = bytearray()
                held += one
        yield sent(bytes(held), last=True)

    blocks = df.select(*FIELDS).mapInArrow(run, "block binary")
    blocks.select(F.col("block").cast("string").alias("value")).write.option("lineSep", "\x00").text(path)
