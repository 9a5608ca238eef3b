"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, bpe, chat, licenses, lines, mixing, near_dup, quality, resampling, simhash, token_files, urls, whitening
from tidemark.llm.scratch import Scratch

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "token_files")
    folder = scratch.path("ids")
    token_files.write(_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    docs = token_files.read(spark, folder, scratch)
    return docs.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix(_table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.groups(_table(spark, sf_dir, "documents"), k=2, percent=80)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.judge(_table(spark, sf_dir, "documents"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), k=20, every=20)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preference_pairs(chat.neighbours(_table(spark, sf_dir, "conversations")))


def chat_reanswered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 9 over pairs that share their turns up to the last answer."""
    return chat.preference_pairs(chat.reanswered(_table(spark, sf_dir, "conversations")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    named = [
        op1_license_scan, op2_token_files, op3_source_mix, op4_near_dup, op5_url_filter, op6_bpe_round_trip, op7_line_dedup, op8_nearest, op9_chat_format,
        op10_quality_rules, op11_whitening, op12_resampling, op13_simhash, chat_reanswered,
    ]
    return {f.__name__: f for f in named}
