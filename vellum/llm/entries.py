"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import bpe, decontam, langcrf, pii, quality, rans, rules, sharding, simhash, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hash_tree": sharding.op1_hash_tree,
    "op2_dated_lists": urls.op2_dated_lists,
    "op3_language_crf": langcrf.op3_language_crf,
    "op4_ngram_ratio": rules.op4_ngram_ratio,
    "op5_quality_net": quality.op5_quality_net,
    "op6_disclosure": pii.op6_disclosure,
    "op7_rans_tokens": rans.op7_rans_tokens,
    "op8_latent_decontam": decontam.op8_latent_decontam,
    "op9_byte_bpe": bpe.op9_byte_bpe,
    "op10_simhash": simhash.op10_simhash,
}
ORACLES: dict[str, str] = {"op1_hash_tree": sharding.oracle(), "op2_dated_lists": urls.ORACLE}
