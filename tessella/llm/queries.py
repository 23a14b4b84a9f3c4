"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from tessella.llm import bpe, forest, near, ngram, packing, pages, quality, repeats, tokencounts, toxicity

QUERIES = {
    "op4_token_counts": tokencounts.query,
    "op2_main_text": pages.query,
    "op7_hash_forest": forest.query,
    "op9_language_model": ngram.query,
    "op1_bpe": bpe.query,
    "op5_packing": packing.query,
    "op3_near_duplicates": near.query,
    "op6_repeated_passages": repeats.query,
    "op8_toxicity": toxicity.query,
    "op10_quality_rules": quality.query,
}

ORACLE_SQL = {
    "op4_token_counts": tokencounts.ORACLE,
}
