"""The queries of this package and, where SQL can say the same, their SQL."""

from __future__ import annotations

from .bpe import op5_byte_bpe
from .counts import op9_token_counts
from .mixing import op8_mix_sources
from .near_duplicates import op6_minhash_near_dedup
from .quality import op7_quality_rules
from .secrets import op1_secret_scans
from .sharding import op3_sharding
from .spans import op2_substring_dedup
from .topk import OP10_SQL, op10_exact_top_k
from .urls import OP4_SQL, op4_url_filters

QUERIES = {
    "op1_secret_scans": op1_secret_scans,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_sharding": op3_sharding,
    "op4_url_filters": op4_url_filters,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_mix_sources": op8_mix_sources,
    "op9_token_counts": op9_token_counts,
    "op10_exact_top_k": op10_exact_top_k,
}

ORACLE_SQL: dict[str, str] = {
    "op4_url_filters": OP4_SQL,
    "op10_exact_top_k": OP10_SQL,
}
