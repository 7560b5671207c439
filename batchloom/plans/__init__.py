"""Registered queries."""

import importlib

from batchloom.plans.registry import ORACLES, QUERIES

for _name in ("sources", "sharding", "rebalance", "batching", "relations", "scoring", "functions", "evaluation", "streaming"):
    importlib.import_module(f"batchloom.plans.{_name}")

__all__ = ["ORACLES", "QUERIES"]
