"""The queries of this subpackage, and the SQL that says the same where SQL can."""

from __future__ import annotations

from plenara.llm import bpe, chat, decontam, langid, linetree, neardup, quality, secrets, sharding, warc


def queries() -> dict:
    return {
        "op1_language_id": langid.op1_language_id,
        "op2_hash_tree_sharding": sharding.op2_hash_tree_sharding,
        "op3_chat_formatting": chat.op3_chat_formatting,
        "op4_warc_derivatives": warc.op4_warc_derivatives,
        "op5_bpe_roundtrip": bpe.op5_bpe_roundtrip,
        "op6_order_minhash": neardup.op6_order_minhash,
        "op7_line_templates": linetree.op7_line_templates,
        "op8_benchmark_decontamination": decontam.op8_benchmark_decontamination,
        "op9_quality_rules": quality.op9_quality_rules,
        "op10_secret_scan": secrets.op10_secret_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_chat_formatting": chat.OP3_SQL,
        "op8_benchmark_decontamination": decontam.OP8_SQL,
    }
