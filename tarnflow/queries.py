"""Registered queries of the library and their DuckDB SQL."""

from __future__ import annotations

from .plans import catalogs, chat, documents, stores, texts

_MODULES = [chat, texts, documents, stores, catalogs]
QUERIES = {name: run for module in _MODULES for name, run in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
FLAGSHIP = "chunk_documents"
