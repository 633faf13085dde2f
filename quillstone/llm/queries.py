"""Queries over the supplied tables, one for each operator of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontaminate, divergence, langid, licences, lines, minhash, oracles, packing, quality, toolcalls, topk, toxicity, warc
from .common import table


def op1_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans", "item_ids")


def op3_block_pruned_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.where("vec_id % 50 = 0"))


def op4_licence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.recognise(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("identifiers", ",").alias("identifiers"), F.array_join("licences", ",").alias("licences"))


def op5_cross_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.without_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op6_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = toolcalls.turns_as_events(table(spark, sf_dir, "conversations"))
    tools = toolcalls.schemas(spark, {"ask": {"chars": ("BIGINT", True), "text": ("STRING", True)}})
    return toolcalls.link(calls, results, tools)


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_noisy_channel_toxicity,
        op2_prefix_decontamination,
        op3_block_pruned_topk,
        op4_licence_rules,
        op5_cross_site_lines,
        op6_sum_of_squares_packing,
        op7_tool_call_linking,
        op8_minhash_near_dedup,
        op9_subword_quality,
        op10_warc_salvage,
        op11_compression_language,
        op12_source_divergence,
        op13_cross_tokenizer_alignment,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op3_block_pruned_topk": oracles.TOPK,
    "op4_licence_rules": oracles.licences_sql(),
    "op5_cross_site_lines": oracles.LINES,
    "op7_tool_call_linking": oracles.TOOLCALLS,
    "op10_warc_salvage": oracles.WARC,
    "op12_source_divergence": oracles.DIVERGENCE,
}
