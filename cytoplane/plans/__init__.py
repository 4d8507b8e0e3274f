"""Runnable queries, one module per area; importing this package registers them."""

from cytoplane.plans import cells, embeddings, losses, statistics, tables, text  # noqa: F401
from cytoplane.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
