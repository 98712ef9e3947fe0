"""Registered queries: every operator on the driver tables, with its SQL."""

from fathom.plans import findings, graph_queries, join_queries, line_queries, root_queries, rule_queries, text_queries  # noqa: F401
from fathom.plans.registry import ORACLES, QUERIES, Query


def all_queries() -> dict[str, Query]:
    """Every query of the library proper."""
    return QUERIES


def all_oracles() -> dict[str, str]:
    """Their SQL, where SQL can express them."""
    return ORACLES
