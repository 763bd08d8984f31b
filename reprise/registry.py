"""The queries of the core and their SQL."""

from .plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
