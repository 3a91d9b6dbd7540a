"""The text operators' queries by name, and their SQL where SQL can express them on whole tables."""

from __future__ import annotations

from panelforge.llm import chat, decontamination, html_extraction, language_id, licenses, near_dedup, packing, quality, repair, secrets, suffix_tree, vector_codes, vector_search

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_benchmark_decontamination": decontamination.op2_benchmark_decontamination,
    "op3_quality_classifier": quality.op3_quality_classifier,
    "op4_chat_formatting": chat.op4_chat_formatting,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_exact_top_k": vector_search.op6_exact_top_k,
    "op7_lm_scoring": suffix_tree.op7_lm_scoring,
    "op8_minhash_near_dedup": near_dedup.op8_minhash_near_dedup,
    "op9_language_id": language_id.op9_language_id,
    "op10_license_scan": licenses.op10_license_scan,
    "op11_vector_code_compression": vector_codes.op11_vector_code_compression,
    "op12_html_extraction": html_extraction.op12_html_extraction,
    "op13_conversation_structure_repair": repair.op13_conversation_structure_repair,
}

ORACLE = {
    "op4_chat_formatting": chat.ORACLE,
    "op6_exact_top_k": vector_search.ORACLE,
    "op2_benchmark_decontamination": decontamination.ORACLE,
    "op10_license_scan": licenses.ORACLE,
    "op11_vector_code_compression": vector_codes.ORACLE,
    "op13_conversation_structure_repair": repair.ORACLE,
}
