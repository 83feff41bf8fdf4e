"""Importing this module registers every query."""

from __future__ import annotations

from stratalens.plans import (  # noqa: F401
    alert_queries,
    client_queries,
    packet_queries,
    pool_queries,
    sample_queries,
    source_queries,
    stream_queries,
)
from stratalens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
