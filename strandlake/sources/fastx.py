"""FASTA and FASTQ: readers, writers and their indexes.

FASTA is split at line starts with ``>``, so large files are read by many tasks. Files of both kinds, and their indexes,
are read in parts: a task guesses where its part's first record begins and says where the record after its last one does.
A guess counts only if the parts before it, from the start of the file, end just there; else the part is read
again from the right place. Where files can't be read at any place, or are compressed, FASTQ is split where a task finds
records of four lines up to the end of its part; what it leaves at both ends is put together with its
neighbours' and parsed as a whole, and so is a file of other records; the others are one task a file.

Names are header lines without the space at their end. Lines may end with CR LF and the last may have no
end. Lines of a record are equally long but for the last. Errors stop the read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators.stored import delete

from .files import PART, SENT, arrow_schema, batches, check_heads, joined, packed, parsed, write_lines

SEQUENCES = "name string, seq string, qual string"


class RecordError(ValueError):
    pass


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq, qual null). A ``+`` line ends the sequence; unequal inner lines are an error, and so is a file
    that begins with another letter than ``>``."""
    check_heads(spark, path, ">")
    raw = spark.read.option("lineSep", "\n>").text(path)
    return raw.where(F.btrim("value", F.lit(" \r\n\t")) != "").mapInArrow(_fasta_rows, SEQUENCES)


def _fasta_rows(batches):
    """Rows of texts that each hold one record, with or without its ``>``."""
    for batch in batches:
        names, seqs = [], []
        for text in batch.column(0).to_pylist():
            head, _, rest = text.removeprefix(">").replace("\r", "").partition("\n")
            lines = [x for x in rest.split("\n") if x]
            end = next((k for k, x in enumerate(lines) if x[0] == "+"), len(lines))
            lines = lines[:end]
            if any(len(x) != len(lines[0]) for x in lines[:-1]):
                raise RecordError(f"lines of a sequence differ in length: {head}")
            names.append(head.rstrip(" "))
            seqs.append("".join(lines))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(seqs, pa.string()), pa.nulls(len(names), pa.string())], names=["name", "seq", "qual"])


#: Bytes read at once.
CHUNK = 1 << 20


def _lines(read: Callable[[int, int], bytes], at: int, size: int) -> Iterator[tuple[int, bytes, int]]:
    """(offset, line without its end, bytes with it) from a byte on; read(at, n) gives n bytes of a file of that size."""
    start, held = at, []
    while at < size:
        data = bytes(read(at, min(CHUNK, size - at)))
        if not data:
            raise OSError(f"no bytes at {at}, before the end of the file")
        at += len(data)
        first, *more = data.split(b"\n")
        held.append(first)
        for x in more:
            line = b"".join(held)
            yield start, line.rstrip(b"\r\n"), len(line) + 1
            start += len(line) + 1
            held = [x]
    line = b"".join(held)
    if line:
        yield start, line.rstrip(b"\r\n"), len(line)


def records(data: bytes, strict: bool = False) -> Iterator[tuple]:
    """(header, sequence lines, quality lines or None); a line is (offset, text, bytes with its end).

    A quality is read by count of letters. strict: a FASTQ record without quality is an error.
    """
    for _, *record in _records(_lines(lambda at, n: data[at : at + n], 0, len(data)), strict):
        yield tuple(record)


def _records(lines: Iterator[tuple[int, bytes, int]], strict: bool = False, until: int | None = None):
    """``records`` with the offsets of their headers before them. Those that begin at a byte or later aren't read; then the
    result is where the first of them begins."""
    line = next(lines, None)
    while line is not None:
        while line is not None and not line[1]:
            line = next(lines, None)
        if line is None:
            return None
        begin = line[0]
        if until is not None and begin >= until:
            return begin
        head = line[1]
        if head[:1] not in (b">", b"@"):
            raise RecordError(f"no record at byte {line[0]}")
        fastq, seq = head[:1] == b"@", []
        line = next(lines, None)
        while line is not None and line[1][:1] != b"+":
            if line[1][:1] == b">":
                if fastq:
                    raise RecordError(f"'>' inside a FASTQ record at byte {line[0]}")
                break
            if not fastq and line[1][:1] == b"@":
                break
            if len(seq) > 1 and len(seq[-1][1]) != len(seq[0][1]):
                raise RecordError(f"lines of a sequence differ in length at byte {line[0]}")
            if len(seq) == 1 and line[1] and len(seq[0][1]) == 0:
                raise RecordError(f"an empty line inside a sequence at byte {line[0]}")
            if line[1] or fastq:
                seq.append(line)
            line = next(lines, None)
        qual = None
        if line is not None and line[1][:1] == b"+":
            need, have, qual = sum(len(x[1]) for x in seq), 0, []
            line = next(lines, None)
            while line is not None and have < need:
                qual.append(line)
                have += len(line[1])
                line = next(lines, None)
            if have != need:
                raise RecordError(f"quality and sequence of {head[1:].decode(errors='replace')} differ in length")
            if need and [len(x[1]) for x in qual] != [len(x[1]) for x in seq if x[1]]:
                raise RecordError(f"quality and sequence of {head[1:].decode(errors='replace')} differ in lines")
            if not need and line is not None and not line[1]:
                line = next(lines, None)  # the empty quality line of an empty read
        elif fastq and strict:
            raise RecordError(f"{head[1:].decode(errors='replace')} ends before its quality")
        yield begin, head, seq, qual
    return None


def _text(lines) -> str:
    return b"".join(x[1] for x in lines).decode()


def _row(begin: int, head: bytes, seq, qual) -> tuple:
    return head[1:].decode().rstrip(), _text(seq), None if head[:1] == b">" and qual is None else _text(qual or ())


def _rows(data: bytes):
    return (_row(0, *r) for r in records(data))


def read_fastx(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq, qual) of FASTA or FASTQ files, by the first letter of each record."""
    return _by_parts(spark, path, _row, SEQUENCES).drop("path")


PIECE = "path string, size long, begin long, stop long, known boolean"
FOUND = "path string, stop long, begin long, end long"


def _by_parts(spark: SparkSession, path: str, row: Callable, schema: str, strict: bool = False) -> DataFrame:
    """path and schema: row(offset of the header, header, sequence lines, quality lines) of every record.

    A task holds a chunk and a record. Files of more than one part are read once before, to find where their parts' records begin.
    """
    files = spark.read.format("binaryFile").load(path)
    found = sorted((f.path, f.length) for f in files.select("path", "length").collect())
    if found and _opened(found[0][0]) is None:
        return parsed(spark, path, lambda data: (row(*r) for r in _records(_lines(lambda at, n: data[at : at + n], 0, len(data)), strict)), schema)
    limit = max(1, min(PART, spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()))
    pieces = [(name, size, 0, size, True) for name, size in found if size <= limit]
    pieces += _pieces(spark, [(name, size) for name, size in found if size > limit], limit, strict)
    own = f"path string, {schema}"
    arrow = arrow_schema(own)

    def run(frames):
        for frame in frames:
            for p in frame.to_pylist():
                with _open(p["path"]) as f:
                    lines = _lines(lambda at, n: f.read_at(n, at), p["begin"], p["size"])
                    yield from batches(((p["path"], *row(*r)) for r in _records(lines, strict, p["stop"])), arrow)

    return _spread(spark, pieces).mapInArrow(run, own)


def _spread(spark: SparkSession, pieces: list[tuple]) -> DataFrame:
    """Pieces as rows: a task for each if they are few, else neighbours together."""
    return spark.createDataFrame(spark.sparkContext.parallelize(pieces, max(1, min(len(pieces), 10_000))), PIECE)


def _pieces(spark: SparkSession, files: list[tuple[str, int]], limit: int, strict: bool) -> list[tuple]:
    """Pieces of files that begin where records do, and cover them.

    Each part is parsed from a guess. From the start of a file on, the place after a part's last record is where the next one has to
    begin; parts with another guess are parsed again, all at once, until every part begins where those before it end.
    """
    parts = {name: [(a, min(a + limit, size)) for a in range(0, size, limit)] for name, size in files}
    guess: dict[tuple[str, int], int] = {}
    ends: dict[tuple[str, int, int], int | None] = {}
    want = [(name, size, a, b, a == 0) for name, size in files for a, b in parts[name]]
    out: list[tuple] = []
    while want:
        for name, stop, begin, end in _spread(spark, want).mapInArrow(_parsed_parts(strict), FOUND).collect():
            guess.setdefault((name, stop), begin)
            ends[name, stop, begin] = end
        want, out = [], []
        for name, size in files:
            at = 0  # where the next record begins; None if only a part to be read again can tell
            for a, b in parts[name]:
                begin = guess.get((name, b)) if at is None else at
                if begin is None or begin >= b:
                    continue
                if (name, b, begin) in ends:
                    out.append((name, size, begin, b, True))
                    at = ends[name, b, begin]
                else:
                    want.append((name, size, begin, b, True))
                    at = ends.get((name, b, guess.get((name, b))))
    return out


def _parsed_parts(strict: bool):
    """(path, stop, begin, end) of pieces: where a part's first record begins, a guess unless known, and where the first
    record at stop or later does. The end of the file is its size. No record, no row. What can't be parsed ends the file: if it
    begins at a true place, the reader of the rows finds the error."""

    def one(f, p):
        read, size, stop = lambda at, n: f.read_at(n, at), p["size"], p["stop"]
        begin = p["begin"] if p["known"] else _guess(read, size, p["begin"], stop, strict)
        if begin is None:
            return None
        found = _records(_lines(read, begin, size), strict, stop)
        try:
            while True:
                next(found)
        except StopIteration as e:
            return p["path"], stop, begin, size if e.value is None else e.value
        except ValueError:
            return p["path"], stop, begin, size

    schema = arrow_schema(FOUND)

    def run(frames):
        for frame in frames:
            out = []
            for p in frame.to_pylist():
                with _open(p["path"]) as f:
                    out.append(one(f, p))
            yield from batches((r for r in out if r is not None), schema)

    return run


def _guess(read, size: int, begin: int, stop: int, strict: bool) -> int | None:
    """Where some records can be read, from a line start of this part that begins like the file."""
    letter = next((x[1][:1] for x in _lines(read, 0, size) if x[1]), b"")
    lines = _lines(read, begin - 1, size)
    next(lines)  # the end of the line before
    for at, line, _ in lines:
        if at >= stop:
            return None
        if line[:1] == letter:
            try:
                for _ in zip(range(4), _records(_lines(read, at, size), strict)):
                    pass
            except ValueError:
                continue
            return at
    return None


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq, qual) of FASTQ files, by many tasks a file.

    Compressed files, and those of stores without random access, are read by Spark's text reader: a task that reads a part of a file takes its records if they have four lines each, from the first place
    where that holds to the end of the part. The lines before that, and a last record that isn't whole, go
    to one small group for each file. Parts with other records (of several lines, or FASTA) go there as a whole.
    A task holds one part (spark.sql.files.maxPartitionBytes) at a time.
    """
    if not packed(spark, path):
        names = spark.read.text(path).inputFiles()
        if names and _opened(unquote(names[0])) is not None:
            return read_fastx(spark, path)
    kept = FASTQ_PART + ", whole boolean"
    lines = spark.read.text(path).select("value", F.input_file_name().alias("path"), F.input_file_block_start().alias("at"))
    cut = lines.mapInArrow(_fastq_parts, kept)
    whole = cut.where("whole").select("name", "seq", "qual")

    def rest(key, pdf):
        text = b"".join(t for _, _, t in sorted(zip(pdf["at"], pdf["k"], map(bytes, pdf["rest"]))))
        return pd.DataFrame(list(_rows(text)), columns=["name", "seq", "qual"], dtype=object)

    return whole.unionByName(cut.where("not whole").groupBy("path").applyInPandas(rest, SEQUENCES))


FASTQ_PART = "path string, at long, k int, rest binary, name string, seq string, qual string"


def _four_lines(lines: list[str], i: int) -> bool:
    """Whether a record of four lines begins at i; at the end of the lines, as far as they go."""
    own = lines[i : i + 4]
    return own[0][:1] == "@" and (len(own) < 3 or own[2][:1] == "+") and (len(own) < 4 or len(own[1]) == len(own[3])) and (len(own) < 2 or own[1][:1] not in ("@", "+", ">"))


def _fastq_parts(batches):
    """Rows of whole records, and up to two of what is left of a part: the lines before them (k 0) and after them (k 1)."""
    names = [f.split()[0] for f in (FASTQ_PART + ", whole boolean").split(", ")]

    def sent(path, at, lines):
        lines = [x.removesuffix("\r") for x in lines]
        n = len(lines)
        for first in range(min(n, 9)):
            ends = range(first, n, 4)
            if n - first >= 4 and all(_four_lines(lines, i) for i in ends):
                break
        else:
            first = n
        end = first + (n - first) // 4 * 4
        rest = [(k, "".join(f"{x}\n" for x in part).encode()) for k, part in ((0, lines[:first]), (1, lines[end:])) if part]
        good = range(first, end, 4)
        rows = len(good) + len(rest)
        blank = [None] * len(good)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([path] * rows, pa.string()),
                pa.array([at] * rows, pa.int64()),
                pa.array([*blank, *(k for k, _ in rest)], pa.int32()),
                pa.array([*blank, *(t for _, t in rest)], pa.binary()),
                pa.array([*(lines[i][1:].rstrip() for i in good), *[None] * len(rest)], pa.string()),
                pa.array([*(lines[i + 1] for i in good), *[None] * len(rest)], pa.string()),
                pa.array([*(lines[i + 3] for i in good), *[None] * len(rest)], pa.string()),
                pa.array([True] * len(good) + [False] * len(rest)),
            ],
            names=names,
        )

    place, held = None, []
    for batch in batches:
        for value, path, at in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if (path, at) != place:
                if held:
                    yield from sent(*place, held)
                place, held = (path, at), []
            held.append(value)
    if held:
        yield from sent(*place, held)


def fasta_record(name: Column, seq: Column, width: int = 0, line_ending: str = "\n") -> Column:
    """The text of a record without its last line end; width 0: one line."""
    if width < 1:
        lines = seq
    else:
        # one pass: a line end after each full line that isn't the last
        lines = F.regexp_replace(seq, f"(?s)(.{{{width}}})(?=.)", "$1" + line_ending)
    return F.concat(F.lit(">"), name, F.lit(line_ending), lines)


def fastq_record(name: Column, seq: Column, qual: Column, line_ending: str = "\n") -> Column:
    return F.concat_ws(line_ending, F.concat(F.lit("@"), name), seq, F.lit("+"), qual)


def write_fasta(df: DataFrame, path: str, width: int = 0, line_ending: str = "\n") -> None:
    write_lines(df.select(fasta_record(F.col("name"), F.col("seq"), width, line_ending).alias("r")), "r", path, line_ending)


def write_fastq(df: DataFrame, path: str, line_ending: str = "\n") -> None:
    write_lines(df.select(fastq_record(F.col("name"), F.col("seq"), F.col("qual"), line_ending).alias("r")), "r", path, line_ending)


def write_one_file(spark: SparkSession, write: Callable[[str], None], path: str, parts: str) -> None:
    """A folder with one file, of what write(folder) writes by many tasks. The folder parts holds its parts until it is there."""
    write(parts)
    joined(spark, parts, f"{path}/part-00000.txt")
    delete(spark, parts)


INDEX = ["name", "length", "offset", "line_base", "line_width", "qual_offset"]
INDEX_SCHEMA = "name string, length bigint, offset bigint, line_base bigint, line_width bigint, qual_offset bigint"


def index_name(header: Column) -> Column:
    """A header's text up to the first white space."""
    return F.regexp_extract(F.rtrim(header), "^(\\S*)", 1)


def _index(begin: int, head: bytes, seq, qual) -> tuple:
    name = (head[1:].decode().split() or [""])[0] if head[1:2].strip() else ""
    first = seq[0] if seq else (begin + len(head) + 1, b"", 0)
    return name, sum(len(x[1]) for x in seq), first[0], len(first[1]), first[2], qual[0][0] if qual else (None if qual is None else first[0])


def scan_index(spark: SparkSession, path: str) -> DataFrame:
    """The index of FASTA or FASTQ files: path and INDEX; qual_offset is null for FASTA."""
    return _by_parts(spark, path, _index, INDEX_SCHEMA, strict=True)


def read_index(spark: SparkSession, path: str, fastq: bool = False) -> DataFrame:
    """A .fai file; rows of other than 5 (FASTQ: 6) whole columns are errors."""
    lines = spark.read.text(path).select(F.rtrim("value").alias("v")).where("v <> ''")
    cells, want = F.split("v", "\t"), 6 if fastq else 5
    good = F.when(F.size(cells) == want, cells).otherwise(F.raise_error(F.concat(F.lit("unexpected number of columns: "), F.col("v"))).cast("array<string>"))
    rows = lines.select(good.alias("c"))
    return rows.select(F.get("c", F.lit(0)).alias("name"), *(F.get("c", F.lit(k)).cast("bigint").alias(INDEX[k]) for k in range(1, want)))


def write_index(index: DataFrame, path: str) -> None:
    write_lines(index.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in INDEX)).alias("r")), "r", path)


def fetch(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """(name, seq, qual) at the places that an index gives, without parsing files.

    The index is of one file (a path of several, or none, is an error) or names files in a column path, as
    scan_index does; then path gives those that count. Its rows are spread over tasks, which read
    only the bytes they need; files of stores without random access are read as a whole, one task a file. Line ends inside a sequence
    are as many bytes as the index says.
    """
    own = index if "qual_offset" in index.columns else index.withColumn("qual_offset", F.lit(None).cast("bigint"))
    files = spark.read.format("binaryFile").load(path)
    n = len(files.inputFiles())
    if "path" not in index.columns:
        if n != 1:
            raise ValueError(f"an index is of one file, but {path} matches {n}")
        own = own.withColumn("path", F.lit(files.select("path").first().path))
    own = own.select("path", *INDEX)
    if n and _opened(files.select("path").first().path) is not None:
        return own.join(files.select("path"), "path", "left_semi").mapInPandas(_fetched, SEQUENCES)
    places = own.groupBy("path").agg(F.collect_list(F.struct(*INDEX)).alias("places"))

    def rows(frames):
        for pdf in frames:
            for data, places in zip(pdf.content, pdf.places):
                yield from _cut(lambda at, n, data=bytes(data): data[at : at + n], places)

    return files.select("path", "content").join(places, "path").select("content", "places").mapInPandas(rows, SEQUENCES)


def _opened(path: str):
    """A file that can be read at any place, or None if its store isn't one that workers can open by themselves."""
    from pyarrow import fs

    try:
        if path.startswith("file:"):
            return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
        store, place = fs.FileSystem.from_uri(quote(path, safe=":/"))
        return store.open_input_file(place)
    except (pa.ArrowException, OSError, ValueError):
        return None


def _open(path: str):
    f = _opened(path)
    if f is None:
        raise OSError(f"can't open {path}")
    return f


def _cut(read, places) -> Iterator[pd.DataFrame]:
    """Rows of places, about SENT bytes at once; read(at, n) gives n bytes."""

    def part(p, at: int) -> str:
        n, base, width = p["length"], p["line_base"], p["line_width"]
        ends = (n - 1) // base if n and base else 0
        return read(at, n + ends * (width - base)).translate(None, b"\r\n").decode()

    held, size = [], 0
    for p in places:
        held.append((p["name"], part(p, p["offset"]), None if pd.isna(p["qual_offset"]) else part(p, int(p["qual_offset"]))))
        size += p["length"]
        if size >= SENT:
            yield pd.DataFrame(held, columns=["name", "seq", "qual"], dtype=object)
            held, size = [], 0
    yield pd.DataFrame(held, columns=["name", "seq", "qual"], dtype=object)


def _fetched(frames):
    for pdf in frames:
        for path, own in pdf.groupby("path", sort=False):
            with _open(path) as f:
                yield from _cut(lambda at, n: f.read_at(n, at), own.astype({c: object for c in INDEX}).to_dict("records"))
