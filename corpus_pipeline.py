"""The corpus pipeline: five stages, each written as Parquet and read again before the next.

Quality rules drop documents; spread lines leave all texts; of each group of near copies
(5-word shingles, similarity 0.8) the smallest id stays; documents that hold a benchmark item go; what is left is
encoded. The last stage returns doc_id, n_tokens, token_ids and decoded_sha256. Stages have no state between them.

Null and empty texts fail the quality rules. A null id is kept, and is never one of a group of copies. Rows that repeat
are treated alike, so they stay or go together; rows that share an id are one document to near-dedup, and documents of
their own elsewhere. Very long texts are read whole, one at a time. Without labels of both classes only the base rules
judge; without benchmark items nothing is contaminated; an empty table stays empty. Other columns pass through all
stages but the last, whatever their names; n_chars, where it is there, follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberline.llm import decontamination, lines, minhash, pieces, quality, registry, stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or the classifier, which is fitted to labelled documents of docs."""
    return quality.keep_good(docs, quality.fit(docs, stage.table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines that spread over many sites out of the texts; n_chars follows the text."""
    out = lines.drop_spread_lines(docs).drop("__n_lines", "__n_removed")
    return lines.with_length(out, "text", "n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return minhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontamination.keep_clean(docs, stage.table(spark, sf_dir, "benchmark"))


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digest of what they decode to."""
    return pieces.encode_column(docs, f"{registry.TOKENIZERS}/piece_bpe_32k.model")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece_encoding", sentencepiece_encoding),
]

#: The classifier and the encoding cannot be said in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = stage.table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage.persisted(step(spark, docs, sf_dir), name)
    return docs
