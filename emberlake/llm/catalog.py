"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from emberlake.llm import conversation_repair, fingerprints, fixity, jaccard_join, mixing, packing, personal_data, quality_rules, secret_scan, token_files, toxicity, whitening

QUERIES = {
    "op1_secret_scan": secret_scan.op1_secret_scan,
    "op1_second_visit": secret_scan.op1_second_visit,
    "op2_fingerprint": fingerprints.op2_fingerprint,
    "op3_jaccard_join": jaccard_join.op3_jaccard_join,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_warc_fixity": fixity.op6_warc_fixity,
    "op6_replica_damage": fixity.op6_replica_damage,
    "op7_token_files": token_files.op7_token_files,
    "op8_token_counts": token_files.op8_token_counts,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_personal_data": personal_data.op12_personal_data,
    "op13_embedding_whitening": whitening.op13_embedding_whitening,
}

ORACLE_SQL = {
    "op1_secret_scan": secret_scan.SQL,
    "op1_second_visit": secret_scan.SECOND_SQL,
    "op3_jaccard_join": jaccard_join.SQL,
    "op4_mix_sources": mixing.SQL,
    "op6_warc_fixity": fixity.SQL,
    "op6_replica_damage": fixity.DAMAGE_SQL,
    "op10_quality_rules": quality_rules.SQL,
    "op11_conversation_repair": conversation_repair.SQL,
}
