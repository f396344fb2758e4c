"""Benchmark decontamination by size-partitioned MinHash containment search.

DataFrame functions only. An item's shingles (five words; a shorter item is one shingle) are
ordered by a hash. Items are partitioned by size; in the partition with sizes up to u an item's sketch
is its u - ceil(0.8 u) + 1 smallest hashes. Any document with at least 0.8 of the item's
shingles holds one of them, whatever the document's length, so the search misses nothing. Candidates are
verified by exact containment of the shingles themselves: where a candidate has a hash of any shingle of an
item, the words are put together and compared.

Words are hashed once, and a shingle's hash is made of its words' hashes, so that no row holds all
shingles of a long text.

Defined results: null, empty and blank texts and items have no shingles and match nothing; rows
without doc_id or item_id take no part; rows with one id are one document or item; other columns
are ignored; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small, stored, unused, words

WORDS, NUM, DEN = 5, 4, 5


def _runs(w: Column, n: int) -> Column:
    """All runs of n words, as strings; none if there are fewer words."""
    last = F.size(w) - n + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))


def _run_hashes(h: Column, n: int) -> Column:
    """Hashes of all runs of n words, from the words' hashes."""
    last = F.size(h) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(n))))).otherwise(F.array().cast("array<long>"))


def _hashed(texts: DataFrame, id_: str) -> DataFrame:
    """(id_, w, h): words and their hashes. Each is a column of its own: inside a lambda it would be made anew for each shingle."""
    return texts.select(id_, words(F.col("text")).alias("w")).withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))


def item_shingles(items: DataFrame) -> DataFrame:
    """(item_id, n, h, shingle, size): distinct shingles of each item, of n words, and how many the item has."""
    w = _hashed(items.where("item_id is not null"), "item_id").where(F.size("w") > 0).withColumn("n", F.least(F.size("w"), F.lit(WORDS)))
    of = lambda k: F.arrays_zip(_run_hashes(F.col("h"), k).alias("h"), _runs(F.col("w"), k).alias("shingle"))
    runs = of(WORDS)
    for k in range(1, WORDS):
        runs = F.when(F.col("n") == k, of(k)).otherwise(runs)
    rows = w.select("item_id", "n", F.inline(runs)).distinct()
    return rows.join(rows.groupBy("item_id").agg(F.count("*").alias("size")), "item_id")


def _sketches(shingles: DataFrame) -> DataFrame:
    """(h, item_id): the smallest hashes of each item, so many as its size partition needs."""
    upper = F.pow(F.lit(2), F.floor(F.log2("size")) + 1).cast("long") - 1  # the partition of sizes 2^i to 2^(i+1) - 1
    wanted = upper - F.ceil(upper * NUM / DEN) + 1
    items = shingles.groupBy("item_id").agg(F.sort_array(F.collect_list("h")).alias("h"), F.first("size").alias("size"))
    return items.select("item_id", F.explode(F.slice("h", 1, F.least(wanted, F.size("h")).cast("int"))).alias("h"))


def contained(docs: DataFrame, items: DataFrame, least_words: int = 1) -> DataFrame:
    """Pairs with containment of 0.8 or more: doc_id, item_id, n_shared, n_item. Items of fewer than least_words words take no part."""
    if least_words > 1:
        items = items.where(F.size(words(F.col("text"))) >= least_words)
    with Scratch(docs.sparkSession) as scratch:
        shingles = scratch(item_shingles(items), "item-shingles")
        lengths = sorted(r.n for r in shingles.select("n").distinct().collect())  # WORDS rows at most
        if not lengths:
            return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_shared long, n_item long")
        sketches = scratch(_sketches(shingles), "item-sketches")
        texts = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
        probes = _hashed(texts, "doc_id").select("doc_id", F.explode(F.concat(*(_run_hashes(F.col("h"), n) for n in lengths))).alias("h"))
        candidates = scratch(probes.join(small(sketches), "h").select("doc_id", "item_id").distinct(), "leak-candidates")

        # where candidates hold a hash of any item: few places, of which the words are then put together
        wanted = texts.join(small(scratch(candidates.select("doc_id").distinct(), "leak-documents")), "doc_id")
        known = scratch(shingles.select("n", "h").distinct(), "item-hashes")
        own = _hashed(wanted, "doc_id")
        places = None
        for n in lengths:
            at = own.select("doc_id", F.posexplode(_run_hashes(F.col("h"), n)).alias("at", "h")).join(small(known.where(F.col("n") == n).select("h")), "h", "left_semi")
            at = at.select("doc_id", F.lit(n).alias("n"), (F.col("at") + 1).alias("at"), "h")
            places = at if places is None else places.unionByName(at)
        places = scratch(places, "leak-places").groupBy("doc_id").agg(F.collect_list(F.struct("n", "at")).alias("places"))
        read = own.select("doc_id", "w").join(places, "doc_id")
        found = read.select("doc_id", F.explode(F.array_distinct(F.transform("places", lambda p: F.array_join(F.slice("w", p["at"], p["n"]), " ")))).alias("shingle"))
        sized = candidates.join(shingles.select("item_id", "shingle", "size"), "item_id")
        shared = found.join(sized, ["doc_id", "shingle"]).distinct().groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"), F.first("size").alias("n_item"))
        return stored(shared.where(F.col("n_shared") * DEN >= F.col("n_item") * NUM), "leaks")


def clean(docs: DataFrame, items: DataFrame, least_words: int = 1) -> DataFrame:
    """The rows of docs that contain no item (of least_words words or more), with all their columns."""
    leak = unused("_leak", docs)
    found = stored(contained(docs, items, least_words).select(F.col("doc_id").alias(leak)).distinct(), "leak-documents")
    return docs.join(small(found), docs["doc_id"] == F.col(leak), "left_anti")
