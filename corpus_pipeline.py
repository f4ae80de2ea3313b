"""From raw documents to token ids: five stages, each on all that the one before kept.

quality_rules drops what the rules or the isolation forest reject; line_dedup takes boilerplate lines of a source out of
the texts; near_dedup keeps one document of each group of near-duplicates (five-word shingles, Jaccard similarity of 0.8
or more: what the trie of fingerprints finds, then what is left), the one with the smallest doc_id; decontaminate drops
documents that hold a benchmark window; byte_bpe encodes what is left and checks that it decodes to the same text. All
but the last return the columns that they were given.

Null texts are empty and fail the quality rules, and so do texts of white space. Documents without an id, or with one
that others have, are told apart by their texts: repeated rows go as near-duplicates, unlike ones stay. Null sources are
one source. Texts of any length pass whole; no documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqcover.llm import bpe, common, decontaminate, linededup, neardup, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, common.table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicated(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encoded(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", without_benchmarks),
    ("byte_bpe", byte_bpe),
]

#: The forest, the fingerprints and the merges have no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            common.forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
