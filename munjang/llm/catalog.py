"""Queries and oracle SQL of the operators of this subpackage."""

from __future__ import annotations

import corpus_pipeline
from munjang.llm import bpe, fingerprints, htmltext, jaccard, packing, pivots, quality, substring, tokenfiles, toxicity

_QUERIES = {
    "op1_ngram_jaccard": jaccard.op1_ngram_jaccard,
    "op2_bpe_codec": bpe.op2_bpe_codec,
    "op3_document_fingerprints": fingerprints.op3_document_fingerprints,
    "op4_html_text": htmltext.op4_html_text,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_token_counts": tokenfiles.op6_token_counts,
    "op7_exact_top_k": pivots.op7_exact_top_k,
    "op8_substring_dedup": substring.op8_substring_dedup,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_quality_classifier": quality.op10_quality_classifier,
    "pipeline": corpus_pipeline.run,
}
_SQL: dict[str, str] = {"op1_ngram_jaccard": jaccard.OP1_SQL, "op7_exact_top_k": pivots.OP7_SQL, "op8_substring_dedup": substring.OP8_SQL}


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
