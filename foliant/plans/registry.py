"""All registered queries of the library proper, with their SQL counterparts."""

from __future__ import annotations

from importlib import import_module

MODULES = ("find_queries", "quality_queries", "layout_queries", "compare_queries", "manifest_queries", "extract_queries", "licence_queries", "stream_queries")


def registered() -> dict[str, tuple]:
    """Name -> (function of session and folder, SQL or None)."""
    found: dict[str, tuple] = {}
    for m in MODULES:
        found |= import_module(f"{__package__}.{m}").QUERIES
    return found
