"""Registered queries: one per operator, each with the SQL that states the same result."""

from suite.base import REGISTRY


def load_all() -> dict:
    """Import every query module and return name -> Query."""
    from suite import images, models, projections, stats, summaries, text  # noqa: F401

    return REGISTRY
