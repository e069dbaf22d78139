"""A pipeline over `documents`: low quality, near copies and benchmark passages go, secrets are masked, and what stays is encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, near_duplicates, pieces, quality, secret_scan
from tidemark.llm.common import forget, scratch, table, tune


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, doesn't reject.

    Null texts are judged as empty; repeated rows share their fate; without labels all stay. Of an empty table nothing stays.
    """
    tune(spark)
    return quality.keep_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near copies; of rows alike in id and text one.

    Null and empty texts are one group; a group without ids keeps one row.
    """
    tune(spark)
    return near_duplicates.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without contamination; they stay as they are, null and empty texts among them, and all do without benchmark items."""
    tune(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in their texts replaced by a mark; null and empty texts, and repeated rows, stay as they are."""
    return secret_scan.redact(docs)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, decoded_sha256 and round_trip of every document; null texts are encoded as empty ones."""
    tune(spark)
    return pieces.round_trip(docs, pieces.model_path())


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_copies_stage),
    ("benchmark decontamination", benchmark_stage),
    ("secret scans", secrets_stage),
    ("SentencePiece encoding and decoding", pieces_stage),
]

#: SQL can't express the classifier, the MinHash join or the merges of a BPE model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in their order over all documents, each written as Parquet and read again as the next one's input.

    What a stage read goes once its own rows are written; the last stage's rows stay in the shared folder.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        path = scratch(spark, f"pipeline-{k}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            forget(spark, before)
        before = path
    return docs
