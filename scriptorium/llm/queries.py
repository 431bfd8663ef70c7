"""The registered queries of this subpackage and the SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bagminhash, cdc, collocations, hnsw, langid, pii, prefix_trie, shuffle, sp_dropout, token_counts, toxicity, winnowing, wrappers


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_merge_dropout_codec": sp_dropout.query,
        "op2_pii_surrogates": pii.query,
        "op3_chunk_dedup": cdc.query,
        "op4_noisy_channel_toxicity": toxicity.query,
        "op5_small_world_search": hnsw.query,
        "op6_bag_minhash": bagminhash.query,
        "op7_wrapper_extraction": wrappers.query,
        "op8_compression_language": langid.query,
        "op9_token_attribution": token_counts.query,
        "op10_winnowing_decontamination": winnowing.query,
        "op11_hypergeometric_shuffle": shuffle.query,
        "op12_pivot_collocations": collocations.query,
        "op13_prefix_trie": prefix_trie.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op10_winnowing_decontamination": winnowing.ORACLE,
        "op12_pivot_collocations": collocations.ORACLE,
        "op13_prefix_trie": prefix_trie.ORACLE,
    }
