"""Queries over the given tables, each with the SQL it is checked against."""

from . import checks, constraints, encodings, frequencies, generation, sources  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
