"""The subpackage's named queries and their DuckDB SQL."""

from __future__ import annotations

from vicinity.llm import langid, licenses, lines, mixing, multi_index, packing, rules, simhash, site_quality, toxicity


def queries() -> dict:
    return {
        "op1_simhash_groups": simhash.op1_simhash_groups,
        "op2_mix_sources": mixing.op2_mix_sources,
        "op3_line_dedup": lines.op3_line_dedup,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_pack_tokens": packing.op5_pack_tokens,
        "pack_conversations": packing.pack_conversation_table,
        "op6_license_scan": licenses.op6_license_scan,
        "op7_quality_rules": rules.op7_quality_rules,
        "op8_language_id": langid.op8_language_id,
        "op9_nearest": multi_index.op9_nearest,
        "op10_site_quality": site_quality.op10_site_quality,
    }


def oracle_sql() -> dict:
    """SQL of the operators that it can express: the others hash, decode, align, learn or search as DuckDB can't."""
    return {"op2_mix_sources": mixing.oracle_sql()}
