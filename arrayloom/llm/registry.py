"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, mixing, ngram_join, pii, quality_classifier, quality_rules, substring_dedup, token_counts, topk_search, toxicity

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_topk_search": topk_search.op2_topk_search,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_ngram_join": ngram_join.op5_ngram_join,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_quality_classifier": quality_classifier.op8_quality_classifier,
    "op9_pii": pii.op9_pii,
    "op10_bpe": bpe.op10_bpe,
}
ORACLES = {
    "op1_mixing": mixing.OP1_SQL,
    "op7_quality_rules": quality_rules.OP7_SQL,
}
