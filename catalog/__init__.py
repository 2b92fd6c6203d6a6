"""Named queries over the given tables, each with independent SQL where SQL can say it."""

from catalog.registry import ORACLE, QUERIES, ROWS

__all__ = ["ORACLE", "QUERIES", "ROWS", "load"]


def load() -> None:
    """Import every module that registers queries."""
    import importlib

    for name in MODULES:
        importlib.import_module(f"catalog.{name}")


MODULES = ("metrics", "forecast", "ingest", "books", "streams", "scalars", "matching", "insights", "decisions", "bundles")
