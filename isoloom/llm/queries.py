"""The registered queries of this subpackage: thin derivations from the operators, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoloom.llm import bpe, chat, html_extract, media, ngram_join, packing, quality, suffix_dedup, toxicity, warc

TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judged(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digests(_table(spark, sf_dir, "pages"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op5_chat_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(_table(spark, sf_dir, "conversations"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(_table(spark, sf_dir, "documents"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(_table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(_table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_packing": op2_packing,
    "op3_warc": op3_warc,
    "op4_bpe": op4_bpe,
    "op5_chat_pairs": op5_chat_pairs,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_ngram_join": op7_ngram_join,
    "op8_html_extract": op8_html_extract,
    "op9_toxicity": op9_toxicity,
    "op10_media": op10_media,
}
ORACLE_SQL: dict[str, str] = {"op1_quality_rules": quality.oracle_sql(), "op5_chat_pairs": chat.oracle_sql()}
