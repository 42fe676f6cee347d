"""The subpackage's queries and SQL, for ``__spark_entry__``."""

from __future__ import annotations

from . import alignment, exact_dedup, filter_audit, fingerprints, language, mixing, near_dedup, packing, quality, sharding, token_counts, topk_search, toxicity

QUERIES = {
    "op1_fingerprints": fingerprints.query,
    "op2_sharding": sharding.query,
    "op3_packing": packing.query,
    "op4_toxicity": toxicity.query,
    "op5_mixing": mixing.query,
    "op6_token_counts": token_counts.query,
    "op7_quality": quality.query,
    "op8_language": language.query,
    "op9_near_dedup": near_dedup.query,
    "op10_exact_dedup": exact_dedup.query,
    "op11_filter_audit": filter_audit.query,
    "op12_alignment": alignment.query,
    "op13_topk_search": topk_search.query,
}

ORACLE_SQL = {
    "op10_exact_dedup": exact_dedup.ORACLE_SQL,
    "op11_filter_audit": filter_audit.ORACLE_SQL,
    "op13_topk_search": topk_search.ORACLE_SQL,
}
