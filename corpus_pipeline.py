"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir) and takes all that the stage before kept. All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.llm import mixing, near_copies as copies, packing, pii, quality, simhash
from quarry.llm.common import cut, word_count
from quarry.llm.tokens import public_vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines that too many documents of their source hold."""
    return _recounted(quality.clean(docs.select(*COLUMNS)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id."""
    return simhash.keep_one(docs.select(*COLUMNS))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those whose 5-word shingles are 0.8 or more like those of one with a smaller id."""
    return copies.drop_near_copies(docs.select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return _recounted(pii.redact(docs.select(*COLUMNS)))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document, in the order of training."""
    planned = mixing.plan(docs.select(*COLUMNS, word_count(F.col("text")).alias("size")), carry=["text", "lang", "n_chars"])
    taken = mixing.occurrences(planned).select("row_id", "position")
    return (planned.select("row_id", *COLUMNS).join(taken, "row_id").repartitionByRange("position", "row_id")
            .sortWithinPartitions("position", "row_id").select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their token ids, sequence and offset."""
    return packing.pack(packing.cut_pieces(docs, public_vocabulary()))


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("personal data", personal_data),
    ("mixing", mix),
    ("packing", pack),
]

#: What ``run`` does: the stages, and after "near dedup", which keeps to op2_simhash's limit, what that limit leaves.
STEPS = [*STAGES[:2], ("near copies", near_copies), *STAGES[2:]]

#: Fingerprints and token ids have no SQL form; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All steps over ``documents``; what a step returns is written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, step) in enumerate(STEPS):
        docs = step(spark, docs, sf_dir)
        if i < len(STEPS) - 1:
            docs = cut(docs, name.replace(" ", "-"))
    return docs
