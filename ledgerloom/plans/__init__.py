"""Composed reports and the query catalogue."""

from __future__ import annotations

from importlib import import_module

MODULES = ("ledger_queries", "text_queries", "feed_queries", "change_queries", "stream_queries", "document_queries")


def load() -> None:
    """Import every module that registers queries."""
    for name in MODULES:
        import_module(f"ledgerloom.plans.{name}")
