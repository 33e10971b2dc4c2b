"""The queries of this subpackage, and the SQL that DuckDB can hold them against."""

from __future__ import annotations

from tidewater.llm import chat, decontam, licences, line_dedup, mixing, near_dup, pii, quality, token_counts, token_shards


def queries() -> dict:
    return {
        "op1_minhash_near_dedup": near_dup.op1_minhash_near_dedup,
        "op2_token_shards": token_shards.op2_token_shards,
        "op3_pii": pii.op3_pii,
        "op4_chat_formatting": chat.op4_chat_formatting,
        "op5_mixing": mixing.op5_mixing,
        "op6_quality_rules": quality.op6_quality_rules,
        "op7_token_counts": token_counts.op7_token_counts,
        "op8_license_scans": licences.op8_license_scans,
        "op9_decontamination": decontam.op9_decontamination,
        "op10_line_dedup": line_dedup.op10_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash_near_dedup": near_dup.OP1_SQL,
        "op3_pii": pii.OP3_SQL,
        "op6_quality_rules": quality.OP6_SQL,
        "op10_line_dedup": line_dedup.OP10_SQL,
    }
