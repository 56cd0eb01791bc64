"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat, embedding_dedup, exact_dedup, fill_middle, language_id, line_dedup, lm_scoring, mixing, ngram_join, packing, quality_rules, toxicity, turn_repair

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_pack_sequences": packing.op2_pack_sequences,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_ngram_jaccard": ngram_join.op5_ngram_jaccard,
    "op6_chat_format": chat.op6_chat_format,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_embedding_dedup": embedding_dedup.op8_embedding_dedup,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_lm_score": lm_scoring.op10_lm_score,
    "op11_quality_rules": quality_rules.op11_quality_rules,
    "op12_fill_middle": fill_middle.op12_fill_middle,
    "op13_turn_repair": turn_repair.op13_turn_repair,
}

ORACLE_SQL = {
    "op3_mix_sources": mixing.OP3_SQL,
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op5_ngram_jaccard": ngram_join.OP5_SQL,
    "op6_chat_format": chat.OP6_SQL,
    "op8_embedding_dedup": embedding_dedup.OP8_SQL,
    "op9_line_dedup": line_dedup.OP9_SQL,
    "op11_quality_rules": quality_rules.OP11_SQL,
    "op12_fill_middle": fill_middle.OP12_SQL,
    "op13_turn_repair": turn_repair.OP13_SQL,
}
