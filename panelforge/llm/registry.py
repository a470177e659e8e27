"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import ann, chat_format, decontaminate, html_extract, jaccard_join, language_id, license_scan, line_dedup, mixing, prefix_trie, quality, suffix_dedup, whitening

QUERIES = {
    "op1_chat_format": chat_format.query,
    "op2_decontaminate": decontaminate.query,
    "op3_quality_ranker": quality.query,
    "op4_jaccard_join": jaccard_join.query,
    "op5_ann_search": ann.query,
    "op6_suffix_dedup": suffix_dedup.query,
    "op7_mix_sources": mixing.query,
    "op8_license_scan": license_scan.query,
    "op9_line_dedup": line_dedup.query,
    "op10_language_id": language_id.query,
    "op11_whitening": whitening.query,
    "op12_html_text": html_extract.query,
    "op13_prefix_trie": prefix_trie.query,
}
ORACLES = {
    "op1_chat_format": chat_format.ORACLE_SQL,
    "op7_mix_sources": mixing.ORACLE_SQL,
    "op8_license_scan": license_scan.ORACLE_SQL,
    "op13_prefix_trie": prefix_trie.ORACLE_SQL,
}
