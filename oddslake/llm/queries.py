"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from oddslake.llm import language_id, line_dedup, mixing, near_dedup, ngram_join, pieces, prefix_trie, quality_model, quality_rules, sharding, token_files, top_k, whitening

QUERIES = {
    "op1_pieces": pieces.query,
    "op2_top_k": top_k.query,
    "op3_quality_model": quality_model.query,
    "op4_token_files": token_files.query,
    "op5_sharding": sharding.query,
    "op6_near_dedup": near_dedup.query,
    "op7_line_dedup": line_dedup.query,
    "op8_mixing": mixing.query,
    "op9_language_id": language_id.query,
    "op10_quality_rules": quality_rules.query,
    "op11_prefix_trie": prefix_trie.query,
    "op12_whitening": whitening.query,
    "op13_ngram_join": ngram_join.query,
}

ORACLE_SQL = {
    "op2_top_k": top_k.ORACLE,
    "op6_near_dedup": near_dedup.ORACLE,
    "op7_line_dedup": line_dedup.ORACLE,
    "op8_mixing": mixing.ORACLE,
    "op11_prefix_trie": prefix_trie.ORACLE,
    "op13_ngram_join": ngram_join.ORACLE,
}
