"""Reversible line dedup: sharded cuckoo filters backed by exact reference-count tables.

A line's key is the line without white space at its ends and with A-Z lower-cased, as a 128-bit
hash. The index keeps three tables in the shared folder:

* ``postings``: (h1, h2, doc_id), each key once for each document;
* ``refs``: (h1, h2, n_docs, max_doc), the exact reference counts;
* ``filters``: for each shard a cuckoo filter of the keys found in at least ``min_docs`` documents.

``insert`` and ``delete`` write what a batch changes: new postings, or the documents gone, and the new
counts of the keys it touches; older tables are read through these and put together after ``LAYERS``
batches. Keys go into or out of the filters as they cross ``min_docs``, so that taking a batch out
again restores the former decisions. Once shards hold twice the keys they are meant for, the filters
are made anew from the exact counts, with more shards.

``apply`` sends keys to the filter of their shard, in parts of about ``PART_POSTINGS`` keys, so that no task
holds a hot line's documents or more than one filter. What a filter may hold is confirmed by the
exact counts; a filter only has to be free of false negatives.

Keys of at least ``min_length`` code points that are in at least ``min_docs`` documents lose all
their lines except in the document with the largest doc_id.

Defined results: a null or empty text is one empty line; rows with one doc_id are one document;
a row without doc_id keeps all its lines and counts for nothing; repeated rows each give their
row; other columns stay as they are (n_lines and n_dropped are replaced); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import ASCII_UPPER, Scratch, small, split_join, stored, unused, utf8

MIN_DOCS, MIN_LENGTH = 3, 20
#: Keys that a shard's filter is meant for; there are as many shards as that needs.
SHARD_KEYS = 50_000
#: Keys that ask a shard's filter in one part; the filter goes to each part.
PART_POSTINGS = 100_000
#: Batches whose tables are read through one another before they are put together.
LAYERS = 8
_LOWER = str.maketrans(ASCII_UPPER, ASCII_UPPER.lower())
_SPACE = " \t\n\x0b\x0c\r"
KEY = ["h1", "h2"]


def line_keys(text: str, min_length: int) -> list[bytes | None]:
    """For each line the hash of its key, or None if the key is too short to count."""
    import xxhash

    out: list[bytes | None] = []
    for line in text.split("\n"):
        key = line.strip(_SPACE)
        if len(key) < min_length:
            out.append(None)
        else:
            key = key.lower() if key.isascii() else key.translate(_LOWER)
            out.append(xxhash.xxh3_128_digest(utf8(key)))
    return out


class Cuckoo:
    """Buckets of four 16-bit fingerprints; 0 is free. Keys are pairs of 64-bit numbers.

    Keys that find no place in ``KICKS`` moves are kept in ``stash``, so an insertion never fails.
    """

    SLOTS, KICKS = 4, 200

    def __init__(self, keys: int = 0, state: bytes | None = None):
        if state is None:
            n = 1 << max(4, int(np.ceil(np.log2(max(1, keys) / self.SLOTS / 0.85))))
            self.table, self.stash = np.zeros((n, self.SLOTS), np.uint16), []
        else:
            n, k = np.frombuffer(state[:16], np.int64)
            self.table = np.frombuffer(state[16 : 16 + n * self.SLOTS * 2], np.uint16).reshape(n, self.SLOTS).copy()
            self.stash = [tuple(x) for x in np.frombuffer(state[16 + n * self.SLOTS * 2 :], np.int64).reshape(k, 2).tolist()]
        self.mask = len(self.table) - 1

    def to_bytes(self) -> bytes:
        head = np.array([len(self.table), len(self.stash)], np.int64)
        return head.tobytes() + self.table.tobytes() + np.array(self.stash, np.int64).tobytes()

    @staticmethod
    def fingerprints(h2: np.ndarray) -> np.ndarray:
        return (h2.astype(np.uint64) % np.uint64(65535)).astype(np.int64) + 1

    def other(self, bucket, finger):
        return (bucket ^ (finger * 0x5BD1E995)) & self.mask

    def insert(self, h1: np.ndarray, h2: np.ndarray) -> None:
        fingers = self.fingerprints(h2).tolist()
        table = self.table
        for b, f in zip((h1 & self.mask).tolist(), fingers):
            for at in (b, self.other(b, f)):
                free = np.flatnonzero(table[at] == 0)
                if len(free):
                    table[at, free[0]] = f
                    break
            else:
                for kick in range(self.KICKS):
                    slot = (f + kick) % self.SLOTS
                    f, table[at, slot] = int(table[at, slot]), f
                    at = self.other(at, f)
                    free = np.flatnonzero(table[at] == 0)
                    if len(free):
                        table[at, free[0]] = f
                        break
                else:
                    self.stash.append((at, f))

    def delete(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Only keys that have been inserted may be deleted."""
        for b, f in zip((h1 & self.mask).tolist(), self.fingerprints(h2).tolist()):
            for at in (b, self.other(b, f)):
                found = np.flatnonzero(self.table[at] == f)
                if len(found):
                    self.table[at, found[0]] = 0
                    break
            else:
                self.stash.remove(next(x for x in self.stash if x[1] == f and x[0] in (b, self.other(b, f))))

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        f = self.fingerprints(h2)
        b = h1 & self.mask
        c = self.other(b, f)
        found = (self.table[b] == f[:, None]).any(1) | (self.table[c] == f[:, None]).any(1)
        for at, finger in self.stash:
            found |= (f == finger) & ((b == at) | (c == at))
        return found


def shard_of(shards: int) -> Column:
    """The high bits of h1 name the shard; buckets use the low ones."""
    return F.pmod(F.shiftright("h1", 40), F.lit(shards)).cast("long")


def _postings(min_length: int):
    def rows(batches):
        for batch in batches:
            docs, digests = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    own = set(line_keys(text, min_length))
                    own.discard(None)
                    docs += [doc] * len(own)
                    digests += own
            h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(docs, pa.int64())], names=[*KEY, "doc_id"])

    return rows


@dataclass
class LineIndex:
    postings: DataFrame
    refs: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int = MIN_DOCS
    min_length: int = MIN_LENGTH
    layers: int = 0

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = MIN_DOCS, min_length: int = MIN_LENGTH, keep: Callable = stored) -> LineIndex:
        """keep stores the tables: for good, or by a Scratch for as long as its block lasts."""
        postings = keep(cls._keys(docs, min_length).distinct(), "line-postings")
        refs = keep(cls._counted(postings), "line-refs")
        often = refs.where(F.col("n_docs") >= min_docs)
        shards = max(1, -(-often.count() // SHARD_KEYS))
        return cls(postings, refs, cls._filled(often, shards, keep), shards, min_docs, min_length)

    @staticmethod
    def _keys(docs: DataFrame, min_length: int) -> DataFrame:
        asked = docs.select("doc_id", "text").where("doc_id is not null")
        return asked.mapInArrow(_postings(min_length), "h1 long, h2 long, doc_id long")

    @staticmethod
    def _counted(postings: DataFrame) -> DataFrame:
        return postings.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("max_doc"))

    @staticmethod
    def _filled(often: DataFrame, shards: int, keep: Callable = stored) -> DataFrame:
        """A filter for each shard that has keys."""

        def fill(key, pdf):
            import pandas as pd

            f = Cuckoo(2 * SHARD_KEYS if shards > 1 else 2 * len(pdf))
            f.insert(pdf.h1.to_numpy(), pdf.h2.to_numpy())
            return pd.DataFrame({"shard": [key[0]], "bits": [f.to_bytes()]})

        return keep(often.select(*KEY, shard_of(shards).alias("shard")).groupBy("shard").applyInPandas(fill, "shard long, bits binary"), "line-filters")

    def _updated(self, gone: DataFrame, come: DataFrame) -> DataFrame:
        """The shards' filters without the keys gone and with those come."""
        change = come.select(*KEY, F.lit(True).alias("add")).unionByName(gone.select(*KEY, F.lit(False).alias("add")))
        change = change.withColumn("shard", shard_of(self.shards))

        def turn(key, old, pdf):
            import pandas as pd

            bits = old.bits.iloc[0] if len(old) else None
            if len(pdf):
                f = Cuckoo(2 * max(SHARD_KEYS, len(pdf)), bits)
                h1, h2, add = pdf.h1.to_numpy(), pdf.h2.to_numpy(), pdf["add"].to_numpy(bool)
                f.delete(h1[~add], h2[~add])
                f.insert(h1[add], h2[add])
                bits = f.to_bytes()
            return pd.DataFrame({"shard": [key[0]], "bits": [bits]})

        return stored(self.filters.groupBy("shard").cogroup(change.groupBy("shard")).applyInPandas(turn, "shard long, bits binary"), "line-filters")

    def _changed(self, postings: DataFrame, counts: DataFrame) -> LineIndex:
        """The index with other postings; counts: the new refs of all keys that are touched (0: gone)."""
        before = self.refs.select(*KEY, F.col("n_docs").alias("before"))
        both = stored(counts.join(before, KEY, "left").withColumn("before", F.coalesce("before", F.lit(0))), "line-change")
        refs = self.refs.join(both.select(*KEY), KEY, "left_anti").unionByName(both.where("n_docs > 0").select(*self.refs.columns))
        layers = self.layers + 1
        if layers >= LAYERS:
            postings, refs, layers = stored(postings, "line-postings"), stored(refs, "line-refs"), 0
        m = self.min_docs
        often = refs.where(F.col("n_docs") >= m)
        n = often.count()
        if n > 2 * self.shards * SHARD_KEYS:
            shards = -(-n // SHARD_KEYS)
            filters = self._filled(often, shards)
        else:
            shards = self.shards
            come, gone = both.where((F.col("before") < m) & (F.col("n_docs") >= m)), both.where((F.col("before") >= m) & (F.col("n_docs") < m))
            filters = self._updated(gone, come)
        return LineIndex(postings, refs, filters, shards, m, self.min_length, layers)

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with more documents; rows of documents that it has already change nothing."""
        new = self._keys(docs, self.min_length).distinct().join(self.postings, [*KEY, "doc_id"], "left_anti")
        new = stored(new, "line-insert")
        postings = self.postings.unionByName(new)
        touched = postings.join(new.select(*KEY).distinct(), KEY, "left_semi")
        return self._changed(postings, self._counted(touched))

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """The index without the documents of the column doc_id."""
        ids = stored(doc_ids.select("doc_id").where("doc_id is not null").distinct(), "line-gone")
        keys = stored(self.postings.join(ids, "doc_id", "left_semi").select(*KEY).distinct(), "line-delete")
        postings = self.postings.join(ids, "doc_id", "left_anti")
        left = self._counted(postings.join(keys, KEY, "left_semi"))
        counts = keys.join(left, KEY, "left").select(*KEY, F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "max_doc")
        return self._changed(postings.select(*KEY, "doc_id"), counts)

    def _probed(self, postings: DataFrame) -> DataFrame:
        """The postings that the filters may hold. postings is read twice, so it should be a stored table."""
        placed = postings.withColumn("shard", shard_of(self.shards))
        parts = F.ceil(F.col("n") / PART_POSTINGS).cast("long").alias("parts")
        asked = placed.groupBy("shard").agg(F.count("*").alias("n")).join(self.filters.select("shard"), "shard").select("shard", parts)
        asked = small(asked)
        nothing = lambda names: [F.lit(None).cast("long").alias(c) for c in names]
        keys = placed.join(asked, "shard").select("shard", F.pmod(F.xxhash64("doc_id"), F.col("parts")).alias("part"), F.lit(None).cast("binary").alias("bits"), *KEY, "doc_id")
        bits = self.filters.join(asked, "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "bits", *nothing([*KEY, "doc_id"]))
        ordered = keys.unionByName(bits).repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("bits").isNull())

        def rows(batches):
            own = None  # the filter of the part that is being read; it comes before the part's keys
            for batch in batches:
                at = 0
                starts = np.flatnonzero(batch.column(2).is_valid().to_numpy(zero_copy_only=False)).tolist()
                h1, h2 = (batch.column(k).fill_null(0).to_numpy(zero_copy_only=False) for k in (3, 4))
                found = np.zeros(len(batch), bool)
                for end in [*starts, len(batch)]:
                    if at < end:
                        found[at:end] = own.contains(h1[at:end], h2[at:end])
                    if end < len(batch):
                        own = Cuckoo(state=batch.column(2)[end].as_py())
                    at = end + 1
                yield batch.select([3, 4, 5]).filter(pa.array(found))

        return ordered.mapInArrow(rows, "h1 long, h2 long, doc_id long")

    def decisions(self, postings: DataFrame) -> DataFrame:
        """(doc_id, drop): the keys, as 16 bytes each, whose lines a document loses. postings should be a stored table."""
        often = self.refs.where(F.col("n_docs") >= self.min_docs)
        lost = split_join(self._probed(postings), often, KEY, "n_docs", "doc_id").where("doc_id <> max_doc")
        return lost.groupBy("doc_id").agg(F.collect_list(F.struct(*KEY)).alias("drop"))

    def apply(self, docs: DataFrame) -> DataFrame:
        """docs with text rewritten, n_lines and n_dropped."""
        with Scratch(docs.sparkSession) as scratch:
            drop = stored(self.decisions(scratch(self._keys(docs, self.min_length).distinct(), "line-asked")), "line-decisions")
        return rewritten(docs, drop, self.min_length)


def rewritten(docs: DataFrame, drop: DataFrame, min_length: int) -> DataFrame:
    """docs without the lines of the keys in drop (doc_id, drop), with n_lines and n_dropped."""
    docs = docs.drop("n_lines", "n_dropped")
    names = docs.columns
    doc, keys = unused("_doc", docs), unused("_keys", docs)
    marked = docs.join(drop.select(F.col("doc_id").alias(doc), F.col("drop").alias(keys)), F.col("doc_id") == F.col(doc), "left").drop(doc)
    at = names.index("text")

    def rows(batches):
        for batch in batches:
            texts, n, dropped = [], [], []
            for text, drop in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()):
                n.append(text.count("\n") + 1 if text else 1)
                if text and drop:
                    gone = {np.array([d["h1"], d["h2"]], np.int64).tobytes() for d in drop}
                    kept = [line for line, key in zip(text.split("\n"), line_keys(text, min_length)) if key not in gone]
                    texts.append("\n".join(kept))
                    dropped.append(n[-1] - len(kept))
                else:
                    texts.append(text)
                    dropped.append(0)
            cols = [pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(dropped, pa.int64())], names=[*names, "n_lines", "n_dropped"])

    schema = StructType([*docs.schema.fields, StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    return marked.mapInArrow(rows, schema)


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_length: int = MIN_LENGTH) -> DataFrame:
    """Builds an index of docs and applies it to them; only its decisions outlive the call."""
    with Scratch(docs.sparkSession) as scratch:
        index = LineIndex.build(docs, min_docs, min_length, scratch)
        drop = stored(index.decisions(index.postings), "line-decisions")
    return rewritten(docs, drop, min_length)
