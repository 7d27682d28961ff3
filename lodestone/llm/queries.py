"""The queries of this subpackage, and their SQL where SQL can express them."""

from lodestone.llm import bpe, chat, exact_dedup, knn, mixing, near_dedup, phrases, prefix_trie, quality, sharding, simhash, substring_dedup, token_counts

QUERIES = {
    "op1_kd_shards": sharding.op1_kd_shards,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_minhash_near_dedup": near_dedup.op3_minhash_near_dedup,
    "op4_chat": chat.op4_chat,
    "op5_quality": quality.op5_quality,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_suffix_dedup": substring_dedup.op7_suffix_dedup,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_bpe": bpe.op9_bpe,
    "op10_voronoi_knn": knn.op10_voronoi_knn,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_simhash": simhash.op12_simhash,
    "op13_phrases": phrases.op13_phrases,
}

SQL = {
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op4_chat": chat.OP4_SQL,
    "op8_mix_sources": mixing.OP8_SQL,
    "op10_voronoi_knn": knn.OP10_SQL,
    "op11_prefix_trie": prefix_trie.OP11_SQL,
    "op13_phrases": phrases.OP13_SQL,
}
