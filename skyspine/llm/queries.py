"""The registered queries of the operators, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skyspine.llm import (alignment, chaining, langid, lloyd, mixing, packing, pii_crf, rule_ledger, token_counts, toxicity, trie_join,
                          voronoi_join, warc)
from skyspine.llm.common import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_voronoi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi_join.query(table(spark, sf_dir, "embeddings"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.query(table(spark, sf_dir, "documents"))


def op4_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ledger.query(table(spark, sf_dir, "documents"))


def op5_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.query(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.query(table(spark, sf_dir, "pages"))


def op7_trie_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_join.query(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.query(table(spark, sf_dir, "documents"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.query(table(spark, sf_dir, "documents"))


def op10_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.query(table(spark, sf_dir, "documents"))


def op11_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.query(table(spark, sf_dir, "embeddings"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.query(table(spark, sf_dir, "documents"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.query(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_voronoi_join, op3_packing, op4_rule_ledger, op5_chaining, op6_warc, op7_trie_join,
                                    op8_mixing, op9_langid, op10_pii_crf, op11_lloyd, op12_alignment, op13_token_counts)}


def oracle_sql() -> dict[str, str]:
    return {"op2_voronoi_join": voronoi_join.SQL, "op4_rule_ledger": rule_ledger.SQL, "op6_warc": warc.SQL, "op7_trie_join": trie_join.SQL,
            "op8_mixing": mixing.SQL, "op11_lloyd": lloyd.SQL}
