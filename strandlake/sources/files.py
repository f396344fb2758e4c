"""Whole files through Spark's own readers and writers, so that any store works."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Largest part of a file that a task reads at once, and what it sends at once: so many bytes, or rows.
PART, SENT, SENT_ROWS = 32 << 20, 4 << 20, 20_000


def batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about SENT bytes of text."""

    def made(held):
        columns = zip(*held) if held else ([] for _ in schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    wide = [k for k, f in enumerate(schema) if pa.types.is_string(f.type) or pa.types.is_binary(f.type)]
    held, size = [], 0
    for row in rows:
        held.append(row)
        for k in wide:
            if row[k] is not None:
                size += len(row[k])
        if size >= SENT or len(held) >= SENT_ROWS:
            yield made(held)
            held, size = [], 0
    if held:
        yield made(held)


def arrow_schema(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def parsed(spark: SparkSession, path: str, parse: Callable[[bytes], Iterator[tuple]], schema: str) -> DataFrame:
    """path and schema: one task a file; the rows that parse gives for its bytes, in batches."""
    own = f"path string, {schema}"
    arrow = arrow_schema(own)

    def run(frames):
        for frame in frames:
            for name, content in zip(frame.column(0), frame.column(1)):
                yield from batches(((name.as_py(), *row) for row in parse(memoryview(content.as_buffer()).cast("B"))), arrow)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, own)


def joined(spark: SparkSession, source: str, path: str) -> None:
    """One file of the parts in a folder, in the order of their names. Bytes go through the driver, a buffer at a time."""
    conf, hadoop = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop
    place, to = hadoop.fs.Path(source), hadoop.fs.Path(path)
    store = place.getFileSystem(conf)
    parts = sorted((x.getPath() for x in store.listStatus(place) if x.getPath().getName().startswith("part-")), key=lambda x: x.getName())
    out = to.getFileSystem(conf).create(to)
    try:
        for part in parts:
            stream = store.open(part)
            try:
                hadoop.io.IOUtils.copyBytes(stream, out, 1 << 20, False)
            finally:
                stream.close()
    finally:
        out.close()


def packed(spark: SparkSession, path: str) -> bool:
    """Whether one of the files is expanded by Spark's text reader."""
    codecs = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration())
    place, uri = spark._jvm.org.apache.hadoop.fs.Path, spark._jvm.java.net.URI
    return any(codecs.getCodec(place(uri(name))) is not None for name in spark.read.text(path).inputFiles())


def check_heads(spark: SparkSession, path: str, letter: str) -> None:
    """An error if a file's first letter that isn't white space is another one. The files are those the driver lists anyway;
    a few bytes of each are read (of compressed ones, after expanding them)."""
    conf, hadoop = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop
    codecs = hadoop.io.compress.CompressionCodecFactory(conf)
    for name in spark.read.text(path).inputFiles():
        place = hadoop.fs.Path(spark._jvm.java.net.URI(name))
        codec = codecs.getCodec(place)
        stream = place.getFileSystem(conf).open(place)
        if codec is not None:
            stream = codec.createInputStream(stream)
        try:
            byte = stream.read()
            while 0 <= byte and bytes([byte]).isspace():
                byte = stream.read()
        finally:
            stream.close()
        if byte >= 0 and chr(byte) != letter:
            raise ValueError(f"{name} begins with {chr(byte)!r}, not {letter!r}")


def write_lines(df: DataFrame, record: str, path: str, line_ending: str = "\n") -> None:
    """The string column ``record`` as text parts, a line ending after each."""
    df.select(F.col(record).alias("value")).write.option("lineSep", line_ending).text(path)
