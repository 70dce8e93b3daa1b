"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import chat, classifier, decontaminate, jaccard, licenses, packing, periods, phrases, quality, shards, spans, tokenfiles, urls

QUERIES = {
    "op1_token_group_matrix": jaccard.op1_token_group_matrix,
    "op2_cost_balanced": packing.op2_cost_balanced,
    "op3_bloom_cascade": urls.op3_bloom_cascade,
    "op4_robust_outliers": quality.op4_robust_outliers,
    "op5_label_propagation": shards.op5_label_propagation,
    "op6_grammar_round_trip": chat.op6_grammar_round_trip,
    "op7_fuzzy_notices": licenses.op7_fuzzy_notices,
    "op8_sentence_spans": spans.op8_sentence_spans,
    "op9_winnowing": decontaminate.op9_winnowing,
    "op10_pairwise_ranking": classifier.op10_pairwise_ranking,
    "op11_plane_shuffle": tokenfiles.op11_plane_shuffle,
    "op12_perfect_hash": phrases.op12_perfect_hash,
    "op13_suffix_automaton": periods.op13_suffix_automaton,
}
ORACLE_SQL = {
    "op3_bloom_cascade": urls.ORACLE_SQL,
    "op6_grammar_round_trip": chat.ORACLE_SQL,
    "op9_winnowing": decontaminate.ORACLE_SQL,
}
