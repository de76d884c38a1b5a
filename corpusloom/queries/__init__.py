"""Queries by name, each beside SQL that says the same."""

from . import applying, chain, facts, host, joins, planning, scale, text, verify  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
