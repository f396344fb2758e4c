"""The corpus pipeline: documents in, packed training sequences out.

Each stage is one operator over all that its predecessor kept. Filtering stages keep the columns of
documents; the line stage rewrites text, and n_chars where it dropped lines.

Defined results: a null or empty text isn't toxic, has one empty line, is linked with nothing, holds no
item and is packed as the end id alone; a null doc_id is never learned from, loses no line and is no copy;
rows with one doc_id are one document to the stages that compare documents, and go or stay together there;
without labels nothing is toxic, without benchmark nothing is a leak; columns beside those of documents
are dropped; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import decontaminate, jaccard, linededup, packing, toxicity
from strandlake.llm.common import mark, succeeded, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return toxicity.reject(docs.select(*COLUMNS), toxicity.fit(docs, table(spark, sf_dir, "labels")))


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in three documents or more stay in the last one only."""
    kept = linededup.dedup_lines(docs.select(*COLUMNS))
    chars = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", chars).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near duplicates on five-word shingles, 0.8 or more: the document with the smallest doc_id stays."""
    return jaccard.keep_one(docs.select(*COLUMNS), 5, 80, 100)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with at least 0.8 of a benchmark item's shingles go."""
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its sequence and place."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_common_lines),
    ("jaccard_join", one_of_each_group),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: Toxicity is learned, so SQL can't express the rows; a test holds them against a brute-force version of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's table replaces the one before it, with all that was stored for it."""
    docs, since = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES[:-1]:
        docs = succeeded(stage(spark, docs, sf_dir), f"stage-{name}", since)
    return STAGES[-1][1](spark, docs, sf_dir)
