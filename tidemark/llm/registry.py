"""Queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from tidemark.llm import bpe, chat, decontaminate, licences, lm, near, pii, quality, repeats, shard


def queries() -> dict:
    return {
        "op1_sharding": shard.op1_sharding,
        "op2_chat_formatting": chat.op2_chat_formatting,
        "op3_ngram_join": near.op3_ngram_join,
        "op4_license_scan": licences.op4_license_scan,
        "op5_suffix_array_dedup": repeats.op5_suffix_array_dedup,
        "op6_pii": pii.op6_pii,
        "op7_decontamination": decontaminate.op7_decontamination,
        "op8_bpe": bpe.op8_bpe,
        "op9_lm_scoring": lm.op9_lm_scoring,
        "op10_quality_rules": quality.op10_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_formatting": chat.ORACLE, "op3_ngram_join": near.ORACLE}
