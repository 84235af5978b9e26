"""The queries of this subpackage and the SQL that checks those which SQL can express."""

from __future__ import annotations

from . import ball_tree, chat, decontamination, jaccard_join, langid, packing, paragraph_dedup, prefix_trie, quality, spelling, suffix_dedup, url_filter, warc

QUERIES = {
    "op1_suffix_array_dedup": suffix_dedup.op1_suffix_array_dedup,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_substring_dedup": paragraph_dedup.op3_substring_dedup,
    "op4_quality": quality.op4_quality,
    "op5_chat_format": chat.op5_chat_format,
    "op6_language_id": langid.op6_language_id,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_warc": warc.op8_warc,
    "op9_ngram_jaccard_join": jaccard_join.op9_ngram_jaccard_join,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_exact_topk": ball_tree.op12_exact_topk,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}
ORACLE_SQL = {
    "op2_decontamination": decontamination.ORACLE,
    "op4_quality": quality.ORACLE,
    "op5_chat_format": chat.ORACLE,
    "op8_warc": warc.ORACLE,
    "op9_ngram_jaccard_join": jaccard_join.ORACLE,
    "op10_url_filter": url_filter.ORACLE,
    "op11_prefix_trie": prefix_trie.ORACLE,
    "op12_exact_topk": ball_tree.ORACLE,
    "op13_spelling_variants": spelling.ORACLE,
}
