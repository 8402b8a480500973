"""The queries of the corpus operators and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clusterloom.llm import chat, decontaminate, fim, licenses, mixing, pii, quality, repeats, sharding, simhash, spelling, tokens, topk


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_weak_supervision_pii": pii.op1_weak_supervision_pii,
        "op2_suffix_interval_dedup": repeats.op2_suffix_interval_dedup,
        "op3_tiered_shards": sharding.op3_tiered_shards,
        "op4_nb_svm_quality": quality.op4_nb_svm_quality,
        "op5_huffman_tokens": tokens.op5_huffman_tokens,
        "op6_simhash_components": simhash.op6_simhash_components,
        "op7_kdtree_topk": topk.op7_kdtree_topk,
        "op8_license_templates": licenses.op8_license_templates,
        "op9_systematic_mix": mixing.op9_systematic_mix,
        "op10_fm_decontamination": decontaminate.op10_fm_decontamination,
        "op11_spelling_variants": spelling.op11_spelling_variants,
        "op12_typed_chat": chat.op12_typed_chat,
        "op13_fill_in_middle": fim.op13_fill_in_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_tiered_shards": sharding.OP3_SQL,
        "op7_kdtree_topk": topk.OP7_SQL,
        "op9_systematic_mix": mixing.OP9_SQL,
        "op10_fm_decontamination": decontaminate.OP10_SQL,
        "op11_spelling_variants": spelling.OP11_SQL,
        "op12_typed_chat": chat.OP12_SQL,
        "op13_fill_in_middle": fim.OP13_SQL,
    }
