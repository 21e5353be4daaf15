"""The registered queries of this subpackage and, where SQL can say them, their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from runlore.llm import ann, caps, chat, decontam, langid, mixing, negatives, pii, secrets, simhash, tokens, trie, warc
from runlore.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(run):
    QUERIES[run.__name__] = run
    return run


@query
def op4_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op4(table(spark, sf_dir, "documents"))


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op8(table(spark, sf_dir, "documents"))


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.op10(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL["op10_decontamination"] = decontam.OP10_SQL


@query
def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op5(table(spark, sf_dir, "documents"))


@query
def op3_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op3(table(spark, sf_dir, "documents"))


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.op2(table(spark, sf_dir, "documents"), public_tokenizers.path(tokens.VOCABULARY))


@query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op6(table(spark, sf_dir, "documents"))


@query
def op7_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.op7(chat.with_control_strings(table(spark, sf_dir, "conversations")))


@query
def op9_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.op9(table(spark, sf_dir, "embeddings"))


@query
def op1_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op1(table(spark, sf_dir, "pages"))


SQL["op1_revisits"] = warc.OP1_SQL


@query
def op12_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.op12(table(spark, sf_dir, "embeddings"))


SQL["op12_cap_filters"] = caps.OP12_SQL


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.op13(table(spark, sf_dir, "embeddings"))


SQL["op13_hard_negatives"] = negatives.OP13_SQL


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.op11(table(spark, sf_dir, "conversations"))


SQL["op11_prefix_trie"] = trie.OP11_SQL
