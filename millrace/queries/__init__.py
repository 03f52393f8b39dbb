"""Registered queries: each operator and job over the given tables, with its SQL oracle."""

from millrace.queries import columns, flows, scans, sinks  # noqa: F401  (registration)
from millrace.queries.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
