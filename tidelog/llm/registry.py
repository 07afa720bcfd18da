"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from tidelog.llm import byte_bpe, conversation_repair, decontamination, exact_dedup, language_id, lm_scoring, ngram_join, packing, pii, substring_dedup, token_counts, toxicity, variant_grouping

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_pii": pii.op2_pii,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_lm_scoring": lm_scoring.op8_lm_scoring,
    "op9_decontamination": decontamination.op9_decontamination,
    "op10_packing": packing.op10_packing,
    "op11_byte_bpe": byte_bpe.op11_byte_bpe,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_variant_grouping": variant_grouping.op13_variant_grouping,
}

ORACLE_SQL = {
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op5_substring_dedup": substring_dedup.OP5_SQL,
    "op9_decontamination": decontamination.OP9_SQL,
}
