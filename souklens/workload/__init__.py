"""Registered queries with the SQL that states the same result."""

from souklens.workload import datasets, graphs, integrity, maintained, published, relational, reports, scalars, storage  # noqa: F401
from souklens.workload.registry import ORACLES, QUERIES, register_views

__all__ = ["ORACLES", "QUERIES", "register_views"]
