"""All registered queries."""

from importlib import import_module

from .registry import ORACLES, QUERIES

MODULES = ["text_queries", "parse_queries", "source_queries", "page_queries", "relational_queries", "resolve_queries", "serving_queries", "search_queries"]


def load() -> None:
    for name in MODULES:
        try:
            import_module(f"{__name__}.{name}")
        except ModuleNotFoundError as e:
            if e.name != f"{__name__}.{name}":
                raise


load()
__all__ = ["ORACLES", "QUERIES"]
