"""The corpus pipeline: raw documents to token ids of clean, distinct, safe text.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before
kept. Between stages the rows are written as Parquet in the shared folder and read
again, so a lost executor never costs more than the stage at hand. All stages but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from foliant.llm import bpe, decontam, quality, queries, secretscan, simhash
from foliant.llm.session import Run, fresh_path, passing


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects."""
    return quality.good(docs, queries.quality_model(docs, queries.table(spark, sf_dir, "labels")))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of SimHash near-duplicates."""
    return simhash.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark passages beyond the limits."""
    return decontam.decontaminate(docs, queries.table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret found in a text; all documents stay."""
    return secretscan.redact(docs, secretscan.fit(docs))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes every text and decodes it again: doc_id, n_tokens, digests of ids and of decoded bytes, ids."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("byte-level BPE", tokens_stage),
]

#: SQL can't express a trained classifier, XXH64 fingerprints or BPE; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. What a stage read or wrote on its way is deleted once its rows are written; the last one's input when the driver ends."""
    docs = queries.table(spark, sf_dir, "documents")
    with Run(spark) as mine:
        for _, stage in STAGES[:-1]:
            kept, path = stage(spark, docs, sf_dir), fresh_path(spark, "pipeline")
            kept.write.parquet(path)
            mine.drop()
            docs = spark.read.schema(kept.schema).parquet(passing(spark, path))
        return STAGES[-1][1](spark, docs, sf_dir)
