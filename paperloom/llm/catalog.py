"""Queries and SQL of the operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import chat, clusters, ledger, manifest, media, mixing, pieces, simhash, substring, suffixes, tokenids, toxicity, warc

_MODULES = {
    "op1_warc_dictionary": warc,
    "op2_simple8b_ids": tokenids,
    "op3_mix_sources": mixing,
    "op4_transcript_hmm": chat,
    "op5_toxicity_fm": toxicity,
    "op6_rule_ledger": ledger,
    "op7_simhash_pivots": simhash,
    "op8_merge_dropout": pieces,
    "op9_recompression": substring,
    "op10_progressive_jpeg": media,
    "op11_radix_suffixes": suffixes,
    "op12_merkle_manifest": manifest,
    "op13_drake_bounds": clusters,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: module.query for name, module in _MODULES.items()} | {"rule_ablations": ledger.ablation_query}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE for name, module in _MODULES.items() if hasattr(module, "ORACLE")} | {"rule_ablations": ledger.ABLATION_ORACLE}
