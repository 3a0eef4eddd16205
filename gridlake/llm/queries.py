"""The registered queries of the training-data operators, with their production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, html_text, jaccard, line_dedup, packing, quality, secrets, token_files, warc
from .oracles import ORACLES

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digests(chat.format_chats(turns))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.find_secrets(_table(spark, sf_dir, "documents")))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_lines(_table(spark, sf_dir, "documents"), 40, 5, digest=True)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"))


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), TOKENIZER, END_ID, 1024)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read(token_files.write(_table(spark, sf_dir, "documents"), TOKENIZER, END_ID))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return warc.find(warc.build_index(warc.write_pages(pages)), pages).drop("url")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(_table(spark, sf_dir, "documents"))


def queries():
    return {
        "op1_spaced_seeds": op1_spaced_seeds, "op2_html_text": op2_html_text, "op3_chat_format": op3_chat_format, "op4_secrets": op4_secrets, "op5_line_dedup": op5_line_dedup,
        "op6_quality": op6_quality, "op7_pack": op7_pack, "op8_token_files": op8_token_files, "op9_warc": op9_warc, "op10_ngram_jaccard": op10_ngram_jaccard,
    }


def oracle_sql():
    return dict(ORACLES)
