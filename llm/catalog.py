"""Registered queries of the operators and their SQL counterparts."""

from __future__ import annotations

from llm import chat, collocations, hard_negatives, leaks, licenses, minhash, mixing, neighbour_graph, packing, posting_lists, token_counts, toxicity, word_quality

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_section_tokens": token_counts.op2_section_tokens,
    "op3_packed_pieces": packing.op3_packed_pieces,
    "op4_nearest_vectors": posting_lists.op4_nearest_vectors,
    "op5_near_vectors": neighbour_graph.op5_near_vectors,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_near_duplicates": minhash.op7_near_duplicates,
    "op8_quality": word_quality.op8_quality,
    "op9_chat_digests": chat.op9_chat_digests,
    "op10_source_mix": mixing.op10_source_mix,
    "op11_collocations": collocations.op11_collocations,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_benchmark_leaks": leaks.op13_benchmark_leaks,
}

SQL = {
    "op5_near_vectors": neighbour_graph.OP5_SQL,
    "op6_license_scan": licenses.OP6_SQL,
    "op7_near_duplicates": minhash.OP7_SQL,
    "op9_chat_digests": chat.OP9_SQL,
    "op10_source_mix": mixing.OP10_SQL,
    "op11_collocations": collocations.OP11_SQL,
    "op12_hard_negatives": hard_negatives.OP12_SQL,
    "op13_benchmark_leaks": leaks.OP13_SQL,
}
