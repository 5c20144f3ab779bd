"""Queries of the engine with their SQL counterparts."""

from quantloom.checks.base import QUERIES, SQL
from quantloom.checks import catalogs, features, functions, joins, logs, portfolio, scale, scoring, signals, streams, validation  # noqa: F401

__all__ = ["QUERIES", "SQL"]
