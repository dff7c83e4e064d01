"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from murmur.llm import decontamination, exact_dedup, html_text, mixing, packing, prefix_trie, repair, sharding, simhash, substring_dedup, token_counts, toxicity, warc

_MODULES = [exact_dedup, sharding, packing, html_text, simhash, substring_dedup, token_counts, toxicity, warc, decontamination, mixing, repair, prefix_trie]


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
