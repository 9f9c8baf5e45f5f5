"""The queries of this folder by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from admeter.llm import bpe, conversation_trie, html_crf, katz, kd_shards, language, merkle, mixing, near_text, near_vectors, quality_rules, token_rollup, token_spans

QUERIES = {
    f.__name__: f
    for f in (
        merkle.op1_merkle_fingerprints,
        katz.op2_katz_backoff,
        kd_shards.op3_kd_tree_shards,
        language.op4_language_id,
        mixing.op5_mixed_blocks,
        near_vectors.op6_subspace_join,
        quality_rules.op7_quality_rules,
        near_text.op8_minhash_hamming,
        bpe.op9_speculative_bpe,
        token_rollup.op10_token_rollup,
        html_crf.op11_html_crf,
        token_spans.op12_token_spans,
        conversation_trie.op13_conversation_trie,
    )
}

ORACLES = {"op10_token_rollup": token_rollup.OP10_SQL}
