"""Registered queries over the driver's tables, each with its SQL oracle where SQL can express it."""

from corvane.plans import state_queries, text_queries  # noqa: F401
from corvane.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
