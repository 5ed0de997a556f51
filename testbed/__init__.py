"""Queries and oracles over the driver's tables."""

from importlib import import_module

SECTIONS = ("sources", "filters", "joins", "aggregates", "functions", "layers", "queries")


def load_cases() -> None:
    """Import the case modules, which register their queries."""
    for section in SECTIONS:
        import_module(f"testbed.cases_{section}")
