"""Queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from tallywood.llm import chat, codes, decontaminate, filters, langid, licenses, neardup, packing, substrings, tokens, toxicity, urls, vectors


def queries() -> dict:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_best_fit_packing": packing.op1_best_fit_packing,
        "op2_minhash_near_dedup": neardup.op2_minhash_near_dedup,
        "op3_url_filters": urls.op3_url_filters,
        "op4_benchmark_decontamination": decontaminate.op4_benchmark_decontamination,
        "op5_license_scan": licenses.op5_license_scan,
        "op6_language_id": langid.op6_language_id,
        "op7_chat_format": chat.op7_chat_format,
        "op10_substring_dedup": substrings.op10_substring_dedup,
        "op8_embedding_near_dedup": vectors.op8_embedding_near_dedup,
        "op9_toxicity": toxicity.op9_toxicity,
        "op11_token_counts": tokens.op11_token_counts,
        "op12_filter_audit": filters.op12_filter_audit,
        "op13_vector_codes": codes.op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_minhash_near_dedup": neardup.OP2_SQL, "op10_substring_dedup": substrings.OP10_SQL, "op3_url_filters": urls.OP3_SQL, "op7_chat_format": chat.OP7_SQL, "op12_filter_audit": filters.OP12_SQL, "op13_vector_codes": codes.OP13_SQL}
