"""From raw documents to packed sequences, in five stages of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes what a stage returns as Parquet in the shared folder and
hands the next stage that table. All but the last return the columns of ``documents``, and further ones as they came, whatever their names.

Edge cases: null texts, empty ones and those of fewer than 50 words fail the quality rules' base and go; very long texts are read whole in every
stage; of documents alike (ties) the smallest id stays; rows that repeat an id are one document to the dedup, which keeps or drops them together, and
rows of their own to the other stages; a null doc_id is linked with nothing and stays; a null source is a source of its own, sorted last; nulls
in other columns have no effect; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skeinwork.llm import entry, mixing, near_dedup, packing, pii, quality_rules
from skeinwork.llm.common import stored


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or leave the compression bands go."""
    return quality_rules.kept_documents(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity of 0.8 or more) the document with the smallest id stays."""
    return near_dedup.kept_documents(docs)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data give way to their kind."""
    return pii.redacted_documents(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source gives the words of its target: documents repeat by epochs, and the one at the budget's end is cut there."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 2048 tokens."""
    return packing.packed_documents(docs, entry.vocabulary(entry.PACKING_VOCABULARY))


STAGES = [
    ("quality rules", quality_rules_stage),
    ("near dedup", near_dedup_stage),
    ("personal data", personal_data_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: zstandard ratios, redaction and tokenizers have no SQL: tests/llm compares the stages with brute force instead.
ORACLE_SQL = None
