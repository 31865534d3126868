"""Registered queries: every operator over the driver's tables, with equivalent SQL."""

from newsmill.suite import (  # noqa: F401
    aggregates, dedup_joins, functions, jobs, predicates, scans, streams, usage_windows,
)
from newsmill.suite.base import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
