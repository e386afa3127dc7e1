"""The registered queries of this subpackage: thin contracts over the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from masthead.llm import dedup, licenses
from masthead.llm.bpe import bpe_digests
from masthead.llm.chat import conversation_digests, format_conversations
from masthead.llm.flac import media_digests, text_to_flac
from masthead.llm.jaccard import near_duplicate_classes
from masthead.llm.langid import language_predictions
from masthead.llm.packing import pack_documents
from masthead.llm.shared import documents
from masthead.llm.tokens import read_definition
from masthead.llm.urls import judge_urls, seed_urls, train_urls
from masthead.llm.wavelet import read_token_shards, write_token_shards

TOKENIZER_FILE = "byte_bpe_50k.json"
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER_FILE)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(documents(spark, sf_dir), read_definition(tokenizer_path()))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_predictions(documents(spark, sf_dir))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(documents(spark, sf_dir), width=4, percent=85)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), read_definition(tokenizer_path()), capacity=2048, end_id=0)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES, train_urls(seed_urls(spark)))


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return read_token_shards(write_token_shards(docs, read_definition(tokenizer_path()), end_id=0), docs.schema["doc_id"].dataType)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], rows.schema)
    return conversation_digests(format_conversations(rows.unionByName(extra), read_definition(tokenizer_path())))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup_report(documents(spark, sf_dir))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(text_to_flac(documents(spark, sf_dir), pad=64))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_license_scan": op2_license_scan,
    "op3_language_id": op3_language_id,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_packing": op5_packing,
    "op6_url_filter": op6_url_filter,
    "op7_token_shards": op7_token_shards,
    "op8_chat_format": op8_chat_format,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_media": op10_media,
}

ORACLES: dict[str, str] = {
    "op2_license_scan": licenses.oracle(),
    "op9_exact_dedup": dedup.ORACLE_SQL,
}
