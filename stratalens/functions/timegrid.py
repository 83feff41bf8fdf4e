"""Integer time arithmetic: every grid is anchored at the epoch, in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND_NS = 1_000_000_000
SECOND_US = 1_000_000


def floor_to(value: Column, step: int) -> Column:
    return value - F.pmod(value, F.lit(step).cast("bigint"))


def ceil_to(value: Column, step: int) -> Column:
    return value + F.pmod(-value, F.lit(step).cast("bigint"))


def grid_index(value: Column, step: int) -> Column:
    """Number of the grid cell that holds ``value``; exact for any BIGINT."""
    width = F.lit(step).cast("bigint")
    return F.call_function("div", value - F.pmod(value, width), width)


def seconds_of(ts_ns: Column) -> Column:
    return F.call_function("div", ts_ns, F.lit(SECOND_NS).cast("bigint"))


def flush_of(ts_ns: Column, every: int) -> Column:
    """Start of the flush window that owns a packet, in epoch seconds."""
    return floor_to(seconds_of(ts_ns), every)
