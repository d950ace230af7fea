"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from . import media, near_dedup, packing, piece_bpe, preferences, prefix_trie, quality_rules, secret_scan, signature_tree, site_quality, site_style, token_counts, turn_repair

_MODULES = [secret_scan, site_quality, near_dedup, token_counts, preferences, piece_bpe, media, quality_rules, packing, site_style, prefix_trie, turn_repair, signature_tree]

QUERIES = {name: run for module in _MODULES for name, run in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
