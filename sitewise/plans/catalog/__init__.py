"""Registered queries, one module per topic."""

from sitewise.plans.registry import ORACLES, QUERIES
from sitewise.plans.catalog import composed, diversity, files, network, structure, topology, traits  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
