"""The queries of this package and their SQL."""

from __future__ import annotations

from llm import collocations, decontam, jaccard_join, license_scan, mixing, packing, pii_spans, quality, substring_dedup, suffix_dedup, toxicity, vector_codes, vector_forest

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_pii": pii_spans.op3_pii,
    "op4_quality": quality.op4_quality,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_license_scan": license_scan.op6_license_scan,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_decontamination": decontam.op8_decontamination,
    "op9_vector_forest": vector_forest.op9_vector_forest,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op11_packing": packing.op11_packing,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_collocations": collocations.op13_collocations,
}

ORACLES = {
    "op1_mixing": mixing.ORACLE,
    "op7_substring_dedup": substring_dedup.ORACLE,
    "op8_decontamination": decontam.ORACLE,
    "op12_vector_codes": vector_codes.ORACLE,
    "op13_collocations": collocations.ORACLE,
}
