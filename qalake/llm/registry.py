"""Queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from . import decontamination, exact_dedup, jaccard_join, lexical_search, merkle_manifest, mixing, quality, simhash_dedup, substring_dedup, suffix_dedup, token_counts, toxicity, url_filter

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_quality": quality.op3_quality,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_jaccard_join": jaccard_join.op7_jaccard_join,
    "op8_mixing": mixing.op8_mixing,
    "op9_decontamination": decontamination.op9_decontamination,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_merkle_manifest": merkle_manifest.op11_merkle_manifest,
    "op12_lexical_search": lexical_search.op12_lexical_search,
    "op13_simhash_dedup": simhash_dedup.op13_simhash_dedup,
}

ORACLES = {
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op4_url_filter": url_filter.ORACLE,
    "op9_decontamination": decontamination.ORACLE,
    "op11_merkle_manifest": merkle_manifest.ORACLE,
    "op12_lexical_search": lexical_search.ORACLE,
}
