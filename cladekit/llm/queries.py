"""One query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitpack, chat, counts, decontam, minhash, packing, pii, repair, rules, search, sharding, suffix, whitening
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f
    return keep


@query("op1_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir))


@query("op2_suffix_dedup")
def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup(table(spark, sf_dir))


@query("op3_suffix_automaton", decontam.ORACLE)
def suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query("op4_multi_index_minhash")
def multi_index_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(table(spark, sf_dir), width=2)


@query("op5_bit_packed_ids")
def bit_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitpack.packed_round_trip(table(spark, sf_dir))


@query("op6_rule_ledger", rules.ORACLE)
def rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.verdicts(table(spark, sf_dir))


@query("op7_quotation_linking", chat.ORACLE)
def quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = chat.link_quotations(table(spark, sf_dir, "conversations"))
    return linked.withColumn("reply_turn", F.coalesce("reply_turn", F.lit(-1)))


@query("op8_separator_scan")
def separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.document_counts(table(spark, sf_dir))


@query("op9_feistel_shards")
def feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query("op10_weak_supervision_pii")
def weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir))


@query("op11_embedding_whitening")
def embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query("op12_conversation_repair", repair.ORACLE)
def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damage(table(spark, sf_dir, "conversations")))


@query("op13_exact_top_k", search.ORACLE)
def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.nearest_rows(table(spark, sf_dir, "embeddings"), every=50)
