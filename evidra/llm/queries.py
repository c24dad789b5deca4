"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from evidra.llm import filter_audit, license_scan, mixing, near_dup, ngram_lm, packing, quality, secret_scan, token_counts, topk_search, vector_near_dup, warc, whitening

QUERIES = {
    "op1_license_scan": license_scan.query,
    "op2_embedding_near_dup": vector_near_dup.query,
    "op3_quality_rules": quality.query,
    "op4_lm_scoring": ngram_lm.query,
    "op5_source_mixing": mixing.query,
    "op6_warc_write": warc.query,
    "op7_minhash_near_dup": near_dup.query,
    "op8_secret_scan": secret_scan.query,
    "op9_token_counts": token_counts.query,
    "op10_best_fit_packing": packing.query,
    "op11_filter_audit": filter_audit.query,
    "op12_topk_search": topk_search.query,
    "op13_embedding_whitening": whitening.query,
}

ORACLES = {
    "op2_embedding_near_dup": vector_near_dup.ORACLE,
    "op6_warc_write": warc.ORACLE,
    "op7_minhash_near_dup": near_dup.ORACLE,
    "op11_filter_audit": filter_audit.ORACLE,
    "op12_topk_search": topk_search.ORACLE,
}
