"""Registered queries over the driver's tables, and their SQL twins for DuckDB."""

from .oracles import ORACLES
from .queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
