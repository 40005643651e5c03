"""The operators of this package as registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sinter.llm import (chat, langid, mixing, neardup, neighbours, packing, phrases, quality, simhash, tokenfile,
                        toxicity, urlfilter, whitening)
from sinter.llm.common import store, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = urlfilter.captures_of(table(spark, sf_dir, "pages"))
    hosts = captures.select(urlfilter.host_of(captures["url"]).alias("host")).filter("host IS NOT NULL")
    return urlfilter.judge(captures, store(urlfilter.list_history(hosts), "url-list"))


def op5_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_file(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_sequences(table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", chat.PLANTED), (-7, 1, "assistant", chat.PLANTED)],
                                    turns.schema)
    return chat.read_back(store(chat.format_conversations(turns.unionByName(planted)), "chat"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source", "times")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    return quality.judge(docs.select("doc_id", "lang", "text"), labels, keep=("doc_id", "lang"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_toxicity": op2_toxicity,
    "op3_neighbours": op3_neighbours,
    "op4_url_filter": op4_url_filter,
    "op5_token_file": op5_token_file,
    "op6_packing": op6_packing,
    "op7_chat_format": op7_chat_format,
    "op8_mixing": op8_mixing,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_quality_rules": op10_quality_rules,
    "op11_whitening": op11_whitening,
    "op12_collocations": op12_collocations,
    "op13_simhash": op13_simhash,
}

ORACLE: dict[str, str] = {
    "op4_url_filter": urlfilter.ORACLE,
    "op7_chat_format": chat.ORACLE,
    "op8_mixing": mixing.ORACLE,
    "op12_collocations": phrases.ORACLE,
}
