"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import decontamination, html_text, language_id, ngram_join, piece_codec, quality_rules, secret_scan, sharding, token_store, url_filters

QUERIES = {
    "op1_line_frequency": quality_rules.op1_line_frequency,
    "op2_link_propagation": url_filters.op2_link_propagation,
    "op3_html_text": html_text.op3_html_text,
    "op4_token_store": token_store.op4_token_store,
    "op5_secret_scan": secret_scan.op5_secret_scan,
    "op6_ngram_join": ngram_join.op6_ngram_join,
    "op7_sharding": sharding.op7_sharding,
    "op8_decontamination": decontamination.op8_decontamination,
    "op9_language_id": language_id.op9_language_id,
    "op10_piece_codec": piece_codec.op10_piece_codec,
}

SQL = {
    "op1_line_frequency": quality_rules.SQL,
    "op2_link_propagation": url_filters.SQL,
    "op5_secret_scan": secret_scan.SQL,
    "op6_ngram_join": ngram_join.SQL,
    "op7_sharding": sharding.SQL,
}
