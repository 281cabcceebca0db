"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from lathe.llm import bpe, cotrain, jaccard_join, media, mixing, order_minhash, secret_scan, substring_dedup, token_count, wavelet

QUERIES = {
    "op1_quality_cotraining": cotrain.op1_quality_cotraining,
    "op2_bpe_roundtrip": bpe.op2_bpe_roundtrip,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_wavelet_tokens": wavelet.op4_wavelet_tokens,
    "op5_token_counts": token_count.op5_token_counts,
    "op6_secret_scan": secret_scan.op6_secret_scan,
    "op7_jaccard_join": jaccard_join.op7_jaccard_join,
    "op8_source_mix": mixing.op8_source_mix,
    "op9_order_minhash": order_minhash.op9_order_minhash,
    "op10_media_sequences": media.op10_media_sequences,
}

ORACLE_SQL: dict[str, str] = {"op3_substring_dedup": substring_dedup.SQL, "op8_source_mix": mixing.SQL}
