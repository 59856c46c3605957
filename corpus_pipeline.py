"""A corpus pipeline of five stages over ``documents``: clean, deduplicate, decontaminate, pseudonymise, pack.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept and returns a DataFrame; all but the
last return the columns of docs. ``run`` writes each stage to the shared folder and reads it again; what a stage saved on its way is deleted then.
Null and empty texts, repeated rows and extra columns are handled as the operators' docstrings state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapeworks.llm import common, decontamination, near_copies, packing, pii, toxicity
from tapeworks.llm.queries import PII_KEY, tokenizer_path


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the toxicity model scores 0.3 or more; learns from docs and the labels of the training fold."""
    return toxicity.keep_clean(docs, toxicity.train(docs, common.table(spark, sf_dir, "labels")))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: keeps the document with the smallest id of each class of near copies, whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    return near_copies.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that overlap a benchmark item."""
    return decontamination.keep_unseen(docs, common.table(spark, sf_dir, "benchmark"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by pseudonyms."""
    return pii.mask_texts(docs, PII_KEY)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the remaining texts into sequences of 2048 tokens; one row per piece."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("toxicity", clean), ("near_dedup", deduplicate), ("decontamination", decontaminate), ("pii", pseudonymise), ("packing", pack)]

#: A model, hashes, a tokenizer and a keyed permutation are beyond SQL; tests/llm recomputes the stages in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with common.scope(spark):
            docs = common.save(stage(spark, docs, sf_dir), name, outlive=True)
    return STAGES[-1][1](spark, docs, sf_dir)
