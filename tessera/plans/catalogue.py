"""The catalogue: one query per operator over the provided tables, and the DuckDB SQL that checks it.

The provided tables stand in for the application's: embeddings for chunks (label: component), documents for files
(path: source/doc_id.lang), orders for reviews (o_custkey: pull request), lineitem for findings, conversations for chats,
events for activity, customer and nation for repositories and users, pages for urls.
"""

from __future__ import annotations

from tessera.plans import chats, code, feeds, indexing, layouts, reviews, structure, texts, vectors  # noqa: F401  registers
from tessera.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
