"""The registered queries of the training-data operators."""

from __future__ import annotations

from . import bpe, centroid_cluster, chat_format, decontaminate, jaccard_join, license_scan, quality_rules, secret_scan, simhash_join, substring_dedup, suffix_dedup, token_align, token_files

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_secret_scan": secret_scan.op2_secret_scan,
    "op3_bpe": bpe.op3_bpe,
    "op4_jaccard_join": jaccard_join.op4_jaccard_join,
    "op5_chat_format": chat_format.op5_chat_format,
    "op6_token_files": token_files.op6_token_files,
    "op7_license_scan": license_scan.op7_license_scan,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_centroid_clusters": centroid_cluster.op11_centroid_clusters,
    "op12_simhash_dups": simhash_join.op12_simhash_dups,
    "op13_token_align": token_align.op13_token_align,
}
ORACLES = {
    "op1_substring_dedup": substring_dedup.ORACLE,
    "op5_chat_format": chat_format.ORACLE,
    "op7_license_scan": license_scan.ORACLE,
    "op11_centroid_clusters": centroid_cluster.ORACLE,
}
