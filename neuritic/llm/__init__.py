"""Operators for training-data pipelines. Nothing else in the library imports this subpackage."""

from . import (
    exact_dedup,
    hard_negatives,
    hmm_lm,
    html_text,
    language_id,
    license_scan,
    media,
    mixing,
    packing,
    shingle_join,
    token_store,
    topk,
    whitening,
)

MODULES = (language_id, packing, shingle_join, html_text, hmm_lm, topk, mixing, token_store, media, license_scan, hard_negatives, whitening, exact_dedup)


def queries():
    """All queries of the subpackage, by name."""
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql():
    """DuckDB SQL for the queries that SQL can express."""
    return {k: v for m in MODULES for k, v in m.ORACLE.items()}
