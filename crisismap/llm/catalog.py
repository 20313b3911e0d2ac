"""Queries of this subpackage and their DuckDB SQL, merged from its operator modules."""

from __future__ import annotations

from crisismap.llm import (
    bpe_codec,
    exact_dedup,
    hard_negatives,
    kd_search,
    language_id,
    lm_score,
    merkle,
    packing,
    pii,
    simhash,
    token_counts,
    toxicity,
    warc,
)

MODULES = (bpe_codec, simhash, pii, exact_dedup, language_id, lm_score, token_counts, kd_search,
           toxicity, packing, warc, merkle, hard_negatives)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
