"""A training corpus from the documents table, in stages of the operators of ``weftline.llm``.

Quality rules come first, so that no later stage spends work on what goes anyway. Near-duplicates go
before shared passages, which are then rare. What is left is packed into sequences.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from weftline.llm.best_fit import packed
from weftline.llm.chaining import without_passages
from weftline.llm.line_quality import kept_documents
from weftline.llm.prob_minhash import without_near_duplicates
from weftline.llm.spill import filesystem, shared_folder
from weftline.sources import read_table

import public_tokenizers  # isort: skip

TOKENIZER = "byte_bpe_50k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines that fail."""
    return kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return without_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that earlier ones have too."""
    return without_passages(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packed(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the signatures nor the tokens; tests/llm/test_pipeline.py has plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the documents table; each result is written and read back as the next one's input.

    What a stage has written goes once the next stage's result is written.
    """
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid4().hex}"
    store, root = filesystem(folder)
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            store.delete_dir(f"{root}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
