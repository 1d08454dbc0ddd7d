"""The training-data pipeline: five stages, each one operator, over the documents table.

Every stage works on all rows of the one before. Rows with null ids, null or empty texts, repeated rows, ties, texts
of any length, empty tables and further columns of any name pass through all stages; what each does with them
stands at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skeinflow.llm import decontaminate, packing, quality, simhash, suffixdedup
from skeinflow.llm._common import cut, table
from skeinflow.llm.queries import VOCABULARY


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts stay, and so does all where labels hold no trusted text; repeated rows are judged alike.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that of the smallest id. Shingles have five words, the similarity is 0.8.

    Documents without a word (null, empty, blank) are one group. Rows with null ids stay; rows that repeat an id are
    kept or go together.
    """
    return simhash.keep_one(docs, width=5, similarity=0.8)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from all documents but the first; documents that become empty go.

    Texts that were null or empty stay, as empty ones. Rows of one id don't take from each other, nor do those of null ids,
    which come last.
    """
    return suffixdedup.keep_first(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Items without a word match nothing. Rows with null ids stay; rows that repeat an id go together.
    """
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left is packed, in tokens of the vocabulary of `op3_token_counts`.

    A document without a token has one row without a bin; rows of equal or null ids are packed each by itself.
    """
    return packing.best_fit(docs, VOCABULARY)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("suffix_dedup", suffix_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]
#: SQL can express neither the language model nor the fingerprints; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result but the last is cut from its lineage."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
