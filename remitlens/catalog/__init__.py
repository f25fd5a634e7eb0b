"""Registered queries over the test tables."""

from importlib import import_module

FAMILIES = ["tables", "labels", "features", "text", "evaluation", "evidence", "support", "models"]


def load() -> None:
    """Import every query family, which registers its queries."""
    for family in FAMILIES:
        import_module(f"remitlens.catalog.{family}")
