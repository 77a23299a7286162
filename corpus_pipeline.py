"""The training corpus from end to end: quality, near-duplicates, repeated passages, source mix, packing.

Every stage takes (spark, docs, sf_dir), works on all rows that the one before it kept, and returns a DataFrame; run() writes each
stage's rows and reads them again. All stages but the last return the columns of documents. After mixing, a document may be there
twice; packing takes each row as a document of its own. Null or odd rows go through as each operator's docstring says.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from glyphloom.llm import fmindex, mixing, nearsets, packing, quality
from glyphloom.llm.common import read, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents with a score below 0.3 go."""
    return quality.filtered(docs, read(spark, sf_dir, "labels"), "quality", 0.3)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8, at a similarity: of each component of near copies, at Jaccard 0.8 or more of their 5-word shingles, the document with the smallest doc_id stays."""
    return nearsets.kept(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: words of windows that also start in a document with a smaller doc_id are cut out of the text; a document left without words goes."""
    return fmindex.deduplicated(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: each row as often as its source's rate and its draw say."""
    return mixing.mix(docs)


def retrieval_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: the pieces of sequences of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing sources to target weights", source_mixing),
    ("packing", retrieval_packing),
]

#: No SQL: the classifier's fit, fingerprints and the tokenizer are beyond it. tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
