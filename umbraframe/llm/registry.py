"""The queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from umbraframe.llm import bpe_transducer, exact_dedup, mixing, near_dedup, pii_disclosure, quality_pu, secrets, tiff_media, token_counts, token_store

QUERIES = {
    "op1_quality_pu": quality_pu.query,
    "op2_bpe_transducer": bpe_transducer.query,
    "op3_content_sort_dedup": exact_dedup.query,
    "op4_weighted_minhash_dedup": near_dedup.query,
    "op5_zstd_token_store": token_store.query,
    "op6_cached_token_counts": token_counts.query,
    "op7_pareto_mixing": mixing.query,
    "op8_entropy_secret_scan": secrets.query,
    "op9_tiff_media": tiff_media.query,
    "op10_pii_disclosure": pii_disclosure.query,
}

SQL = {
    "op3_content_sort_dedup": exact_dedup.SQL,
    "op7_pareto_mixing": mixing.SQL,
    "op8_entropy_secret_scan": secrets.SQL,
    "op10_pii_disclosure": pii_disclosure.SQL,
}
