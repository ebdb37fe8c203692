"""From raw documents to training tokens, in five stages.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept, and returns the
columns of ``documents`` (the last one: token digests of every document of the mix).  Between
stages the rows are written as Parquet into the shared folder that the cluster names in
``spark.checkpoint.dir`` and read back, so a lost executor costs a stage at most.

Defined results: null text counts as empty in every stage, and null ids, null sources and extra
columns (of any name) are carried through the filtering stages; empty texts are equal to each other,
so at most one stays; of repeated rows one stays, and the mix may then take it twice; very long texts
are read whole; an empty table gives an empty table with the last stage's columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from docshield.llm import bpe, exact_dedup, mixing, quality, simhash
from docshield.llm.catalog import vocabulary
from docshield.llm.common import documents
from docshield.session import ensure_checkpoint_dir


def accept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.survivors(docs)


def spread(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.representatives(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.copies(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text."""
    return bpe.digests(bpe.encode_and_decode(docs, vocabulary()))


STAGES = [
    ("quality_classifier", accept),
    ("exact_dedup", distinct),
    ("simhash_near_dedup", spread),
    ("source_mixing", mix),
    ("bpe_tokens", tokenise),
]

#: EM, fitted weights and BPE have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
