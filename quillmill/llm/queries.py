"""The corpus queries and their SQL, by name."""

from __future__ import annotations

import corpus_pipeline

from . import bpe, centroids, decontamination, exact_dedup, html_text, language_id, licenses, near_dedup, sharding, spelling, substring_dedup, token_counts, toxicity

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_bpe": bpe.op3_bpe,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_decontamination": decontamination.op5_decontamination,
    "op6_licenses": licenses.op6_licenses,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_sharding": sharding.op10_sharding,
    "op11_spelling": spelling.op11_spelling,
    "op12_main_text": html_text.op12_main_text,
    "op13_centroids": centroids.op13_centroids,
    "slot_map_edit": sharding.slot_map_edit,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op4_near_dedup": near_dedup.ORACLE,
    "op6_licenses": licenses.ORACLE,
    "op8_substring_dedup": substring_dedup.ORACLE,
    "op10_sharding": sharding.ORACLE,
    "op11_spelling": spelling.ORACLE,
    "op13_centroids": centroids.ORACLE,
}
