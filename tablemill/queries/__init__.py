"""Registered queries: one or more per operator, each with its SQL twin."""

from tablemill.queries import catalog, documents, ledger, logs, streams, sync, transfer  # noqa: F401
from tablemill.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
