"""Queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from tidecast.llm import embedding_dedup, filter_audit, html_extract, lm_scoring, mixing, near_dedup, quality, quality_classifier, sentencepiece_codec, sharding, token_counts, url_filters, variants
from tidecast.llm.oracle import SQL

QUERIES = {
    "op1_minhash_near_dedup": near_dedup.op1,
    "op2_sentencepiece": sentencepiece_codec.op2,
    "op3_quality_rules": quality.op3,
    "op4_sharding": sharding.op4,
    "op5_html_extraction": html_extract.op5,
    "op6_lm_scoring": lm_scoring.op6,
    "op7_mixing": mixing.op7,
    "op8_embedding_near_dedup": embedding_dedup.op8,
    "op9_url_filters": url_filters.op9,
    "op10_token_counts": token_counts.op10,
    "op11_spelling_variants": variants.op11,
    "op12_filter_audit": filter_audit.op12,
    "op13_quality_classifier": quality_classifier.op13,
}

__all__ = ["QUERIES", "SQL"]
