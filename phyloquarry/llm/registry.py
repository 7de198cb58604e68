"""The queries of this package and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("bpe", "context_tree", "conversation_repair", "decontamination", "html_extraction", "jaccard_join", "knn_join", "language_id", "phrase_dedup", "pii", "prefix_trie", "sharding", "token_counts")


def registered() -> dict:
    """Query name to (callable, SQL or None)."""
    found = {}
    for name in MODULES:
        found |= import_module(f"{__package__}.{name}").QUERIES
    return found
