"""The registered queries of the text operators, and their SQL."""

from __future__ import annotations

from perfweave.llm import alignment, decontamination, exact_dedup, fingerprints, html, mixing, near_dedup, quality, sharding, substrings, suffixes, toxicity, whitening

QUERIES = {
    "op1_substring_dedup": substrings.op1_substring_dedup,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_sharding": sharding.op3_sharding,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_html": html.op5_html,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_suffix_dedup": suffixes.op7_suffix_dedup,
    "op8_decontamination": decontamination.op8_decontamination,
    "op9_mixing": mixing.op9_mixing,
    "op10_quality": quality.op10_quality,
    "op11_token_alignment": alignment.op11_token_alignment,
    "op12_whitening": whitening.op12_whitening,
    "op13_fingerprints": fingerprints.op13_fingerprints,
}

SQL = {
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op9_mixing": mixing.OP9_SQL,
}
