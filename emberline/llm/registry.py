"""The queries of this package and their SQL twins."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, lines, lm_scoring, minhash, oracles, pieces, quality, sharding, stage, substrings, warc

Query = Callable[[SparkSession, str], DataFrame]

HARD_TEXT = oracles.HARD
SHARDS = 24
#: Folder of the public vocabulary files.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stage.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD_TEXT).alias("text"))
    back = chat.read_chats(chat.format_chats(rows.unionByName(extra)))
    body = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(body, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = stage.table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return lm_scoring.score_documents(stage.table(spark, sf_dir, "documents"), good).withColumnRenamed("id", "doc_id")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stage.new_path(spark, "warc")
    warc.write_archives(stage.table(spark, sf_dir, "pages"), path)
    return warc.resolved(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash.near_duplicates(stage.table(spark, sf_dir, "documents"), n=4)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_spread_lines(stage.table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("__n_lines").cast("long").alias("n_lines"), F.col("__n_removed").cast("long").alias("n_removed"), F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign(stage.table(spark, sf_dir, "documents"), "doc_id", "text", SHARDS)
    return out.select(F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = stage.table(spark, sf_dir, "documents")
    model = quality.fit(docs, stage.table(spark, sf_dir, "labels"))
    return quality.score(docs, model).drop("probability")


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.drop_repeats(stage.table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("span_start").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(stage.table(spark, sf_dir, "documents"), stage.table(spark, sf_dir, "benchmark"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_column(stage.table(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model")


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_chat_formatting, op2_lm_scoring, op3_warc, op4_minhash_near_dedup, op5_line_dedup, op6_sharding, op7_quality_rules, op8_suffix_array_dedup, op9_decontamination, op10_sentencepiece)}
ORACLE_SQL: dict[str, str] = dict(oracles.SQL)
