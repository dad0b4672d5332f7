"""The queries of this folder and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from importlib import import_module

MODULES = ["token_files", "url_filter", "packing", "jaccard_join", "chat", "decontaminate", "warc", "suffix_dedup", "quality_rules", "phrase_dedup", "prefix_trie", "neighbours", "importance"]


def entries() -> dict[str, tuple]:
    """Name -> (query, SQL or None)."""
    found = [import_module(f"{__package__}.{m}").QUERY for m in MODULES]
    return {name: (query, sql) for name, query, sql in found}
