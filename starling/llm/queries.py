"""The registered query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

from starling.llm import (chat, exact_dedup, hard_negatives, hmm, kmeans_tree, order_minhash, packing, pieces, prefix_trie,
                          quality_mil, quality_rules, sharding, token_counts)

QUERIES = {
    "op1_packing": packing.op1,
    "op2_token_counts": token_counts.op2,
    "op3_quality_mil": quality_mil.op3,
    "op4_pieces": pieces.op4,
    "op5_sharding": sharding.op5,
    "op6_hmm": hmm.op6,
    "op7_quality_rules": quality_rules.op7,
    "op8_exact_dedup": exact_dedup.op8,
    "op9_chat_format": chat.op9,
    "op10_order_minhash": order_minhash.op10,
    "op11_hard_negatives": hard_negatives.op11,
    "op12_prefix_trie": prefix_trie.op12,
    "op13_kmeans_tree": kmeans_tree.op13,
}
ORACLES = {
    "op8_exact_dedup": exact_dedup.ORACLE,
    "op11_hard_negatives": hard_negatives.ORACLE,
    "op12_prefix_trie": prefix_trie.ORACLE,
}
