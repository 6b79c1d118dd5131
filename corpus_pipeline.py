"""A pipeline over the documents, in stages that each work on what the one before kept.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next
one's docs.  All but the last return the columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sketchfield.llm import near_dup, packing, quality_fm, quality_rules, queries, suffix_dedup
from sketchfield.llm._common import Scratch, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither fail a base rule nor come from a rejected host."""
    return quality_rules.kept_documents(docs)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine, trained on labelled ones of its input, accepts."""
    return quality_fm.kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, of five-word shingles and a similarity of 0.8."""
    return near_dup.kept_documents(docs, percent=80, size=5)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that repeat in ones of smaller doc_id, and ``n_chars`` of what is left."""
    return suffix_dedup.without_repeats(docs, count="n_chars")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, packed into sequences."""
    return packing.packed(docs, queries.tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("near_dedup", near_dedup_stage),
    ("suffix_dedup", suffix_dedup_stage),
    ("best_fit_packing", packing_stage),
]

#: No SQL expresses the trained classifier or the tokenizer; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch() as scratch:
        for name, stage in STAGES[:-2]:
            docs = scratch.stored(stage(spark, docs, sf_dir), name)
            scratch.drop(keep=1)
        name, stage = STAGES[-2]
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
