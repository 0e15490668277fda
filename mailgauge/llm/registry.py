"""Queries of the ten corpus operators and the pipeline, and their DuckDB twins."""

from __future__ import annotations

from mailgauge.llm import exact_dedup, ngram_join, packing, pieces, pii, secrets, sharding, token_files, toxicity, vector_join


def queries() -> dict:
    return {
        "op1_token_files": token_files.query,
        "op2_feistel_shards": sharding.query,
        "op3_best_fit_packing": packing.query,
        "op4_sentencepiece": pieces.query,
        "op5_vector_join": vector_join.query,
        "op6_toxicity": toxicity.query,
        "op7_pii": pii.query,
        "op8_ngram_jaccard": ngram_join.query,
        "op9_secrets": secrets.query,
        "op10_exact_dedup": exact_dedup.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_secrets": secrets.oracle(), "op10_exact_dedup": exact_dedup.ORACLE}
