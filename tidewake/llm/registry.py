"""The registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from tidewake.llm import conversations, decontamination, license_scan, merkle, mixing, packing, quality_classifier, quality_rules, sharding, simhash, suffix_dedup, token_counts, url_filter

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_quality_classifier": quality_classifier.op3_quality_classifier,
    "op4_source_mix": mixing.op4_source_mix,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_simhash_dedup": simhash.op6_simhash_dedup,
    "op7_license_scan": license_scan.op7_license_scan,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_sharding": sharding.op10_sharding,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_conversation_repair": conversations.op12_conversation_repair,
    "op13_packing": packing.op13_packing,
}

ORACLES = {
    "op4_source_mix": mixing.OP4_SQL,
    "op7_license_scan": license_scan.OP7_SQL,
    "op8_url_filter": url_filter.OP8_SQL,
    "op11_merkle_manifest": merkle.OP11_SQL,
}
