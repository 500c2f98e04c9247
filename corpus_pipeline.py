"""A training-corpus pipeline: quality rules, exact dedup, near-dedup, source mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of ``documents``.

SQL cannot express the learned rules and the tokeniser, so there is no ``ORACLE_SQL``; the tests hold
every stage against a brute-force version on its own input.

Defined cases, the same for all stages: an empty table stays empty; a null text is an empty one (the rules reject it,
the other stages keep it as an empty document); null ids are ids like others and never represent a group that has
another id; a null source or language is a value of its own; repeated rows are rows of their own until a deduplication
keeps one; very long texts are read whole; extra columns, whatever their names, travel along as far as packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postmine.llm import exact_dedup, mixing, near_dedup, packing, quality_rules
from postmine.llm.common import read_table, scratch
from postmine.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the decision list learned from the labels (no labels: no learned
    rules). Null and empty texts have no words and go."""
    return quality_rules.kept_documents(docs, read_table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space; null and blank texts are one
    group, repeated rows are copies."""
    return exact_dedup.deduplicated(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component linked at 0.8 over five-word shingles. Documents without words are
    linked with nothing and stay; of repeated rows one stays."""
    return near_dedup.representatives(docs, size=5)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document repeated by its Poisson count (equal weights of all sources), shuffled. A source without
    text has rate 0; repeated rows share their count."""
    return mixing.replicate(docs).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1,024 tokens with their sequence and offset; an empty text is one end token."""
    return packing.packed_documents(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("poisson_mix", mixing_stage),
    ("best_fit_packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
