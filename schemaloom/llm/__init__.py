"""Operators for preparing training corpora. Nothing outside this package imports it but the entry module, which can do without."""

from __future__ import annotations

from importlib import import_module

MODULES = ("sharding", "language", "toxicity", "warc", "bpe", "secrets", "token_counts", "decontaminate", "simhash", "exact_dedup", "line_dedup", "importance", "conversations")


def registered() -> tuple[dict, dict]:
    """The queries of all operators and their DuckDB SQL."""
    queries, oracle = {}, {}
    for name in MODULES:
        module = import_module(f"{__name__}.{name}")
        queries |= module.QUERIES
        oracle |= module.ORACLE
    return queries, oracle
