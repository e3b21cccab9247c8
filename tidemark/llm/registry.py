"""The subpackage's queries and their SQL statements by name."""

from __future__ import annotations

from tidemark.llm import bpe, chat, forest, id_matrix, oracles, packing, quality, repeats, simhash, token_cache, toxicity

QUERIES = {
    "op1_divergence_rules": quality.op1_divergence_rules,
    "op2_chat_templates": chat.op2_chat_templates,
    "op3_id_matrices": id_matrix.op3_id_matrices,
    "op4_toxicity_compression": toxicity.op4_toxicity_compression,
    "op5_simhash_popcount": simhash.op5_simhash_popcount,
    "op6_bpe_replay": bpe.op6_bpe_replay,
    "op7_token_counts": token_cache.op7_token_counts,
    "op8_swap_packing": packing.op8_swap_packing,
    "op9_projection_forest": forest.op9_projection_forest,
    "op10_suffix_dedup": repeats.op10_suffix_dedup,
}
ORACLES: dict[str, str] = {
    "op1_divergence_rules": oracles.OP1,
    "op2_chat_templates": chat.OP2_SQL,
    "op9_projection_forest": oracles.OP9,
}
