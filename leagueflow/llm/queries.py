"""Registered queries of the corpus operators and their DuckDB oracles."""

from __future__ import annotations

from leagueflow.llm import decontaminate, exact_dedup, extract, langid, lexical, licenses, lmscore, mixing, negatives, packing, secrets, simhash, suffix_dedup

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_html_extract": extract.op4_html_extract,
    "op5_language_id": langid.op5_language_id,
    "op6_lm_score": lmscore.op6_lm_score,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_simhash_neardup": simhash.op9_simhash_neardup,
    "op10_license_scan": licenses.op10_license_scan,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_packing": packing.op12_packing,
    "op13_ranked_search": lexical.op13_ranked_search,
}

ORACLES = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op2_secret_scan": secrets.ORACLE,
    "op3_mix_sources": mixing.ORACLE,
    "op11_hard_negatives": negatives.ORACLE,
    "op13_ranked_search": lexical.ORACLE,
}
