"""Request/response pairing, pairing-table depth and fixed-bound histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.functions.slices import lag_within, running_sum
from stratalens.functions.timegrid import SECOND_NS
from stratalens.operators.clients import request_intervals

PAIRING_TTL_S = 2
PENDING_CAP = 50_000
# Order of moves at one instant: an entry that is exactly the time limit old still counts.
ARRIVAL, TIMEOUT = 1, 2

# Fixed bucket bounds in seconds; every histogram also has +Inf.
INTERVAL_BOUNDS = [0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0, 256.0, 512.0]
LATENCY_BOUNDS = [20e-6, 50e-6, 100e-6, 200e-6, 500e-6, 1e-3, 2e-3, 5e-3, 10e-3, 25e-3, 50e-3]


def _linkable(packets: DataFrame) -> DataFrame:
    return packets.where(F.col("xid").isNotNull()).select("seq", "ts_ns", "direction", "client_ip", "xid")


def pair_latency(packets: DataFrame, ttl: float = PAIRING_TTL_S) -> DataFrame:
    """Responses whose previous packet of the same (client, id) is a fresh request.

    That is the table semantics in one look back: a newer request overwrites an
    older one, and a response uses up the request, so the next response finds a
    response before it. A request exactly ``ttl`` old still matches.
    """
    horizon = int(ttl * SECOND_NS)
    lagged = lag_within(
        _linkable(packets), ["client_ip", "xid"], "ts_ns", ["seq"],
        {"_prev_dir": "direction", "request_ns": "ts_ns"}, horizon,
    )
    delta = F.col("ts_ns") - F.col("request_ns")
    return lagged.where(
        (F.col("direction") == "response")
        & (F.col("_prev_dir") == "request")
        & delta.between(0, horizon)
    ).select("seq", "ts_ns", "client_ip", "xid", "request_ns", (delta / SECOND_NS).alias("seconds"))


def pending_depth(
    packets: DataFrame, cap: int = PENDING_CAP, ttl: float = PAIRING_TTL_S,
    shards: int = 1, slice_s: int | None = None,
) -> DataFrame:
    """Open requests met by each linkable request, and whether the table was full.

    An entry closes at its response, or ``ttl`` after its last request; a newer
    request of the same key keeps it open and is never an overflow. The depth is
    a running sum of opens and closes in time order, summed slice by slice.
    Overflowing requests are counted, not refused, so they still add depth.
    """
    horizon = int(ttl * SECOND_NS)
    width = (slice_s or max(1, int(8 * ttl))) * SECOND_NS
    rows = lag_within(
        _linkable(packets), ["client_ip", "xid"], "ts_ns", ["seq"],
        {"_prev_dir": "direction", "_prev_ns": "ts_ns"}, horizon, width,
    )
    held = (F.col("_prev_dir") == "request") & (F.col("ts_ns") - F.col("_prev_ns") <= horizon)
    held = F.coalesce(held, F.lit(False))
    is_request = F.col("direction") == "request"

    def move(at: Column, kind: int, step: int, role: str | None = None) -> Column:
        return F.struct(
            at.alias("at_ns"), F.lit(kind).alias("kind"), F.lit(step).cast("bigint").alias("step"),
            F.lit(role).cast("string").alias("role"),
        )

    now, timeout = F.col("ts_ns"), F.col("ts_ns") + horizon
    moves = F.array_compact(
        F.array(
            # A request that finds no entry opens one; one that does leaves the depth alone.
            F.when(is_request & ~held, move(now, ARRIVAL, 1, "new")),
            F.when(is_request & held, move(now, ARRIVAL, 0, "held")),
            # Each request schedules its timeout; a row that finds the entry cancels it.
            F.when(is_request, move(timeout, TIMEOUT, -1)),
            F.when(held, move(F.col("_prev_ns") + horizon, TIMEOUT, 1)),
            F.when(held & ~is_request, move(now, ARRIVAL, -1)),
        )
    )
    shard = F.pmod(F.xxhash64("client_ip"), F.lit(shards)).cast("int")
    no_seq = F.lit(-1).cast("bigint")
    summed = (
        rows.select("seq", shard.alias("shard"), F.inline(moves))
        .groupBy("shard", "at_ns", "kind", F.when(F.col("kind") == ARRIVAL, F.col("seq")).otherwise(no_seq).alias("seq"))
        .agg(F.sum("step").alias("step"), F.max("role").alias("role"))
    )
    depth = running_sum(summed, ["shard"], "at_ns", ["kind", "seq"], "step", "_after", width)
    found = F.col("_after") - F.col("step")
    return depth.where(F.col("role").isNotNull()).select(
        "seq", F.col("at_ns").alias("ts_ns"), "shard", found.alias("depth"),
        ((F.col("role") == "new") & (found >= cap)).alias("overflow"),
    )


def histogram(df: DataFrame, value: str, bounds: list[float], keys: list[str] | None = None) -> DataFrame:
    """Cumulative counts for inclusive upper bounds and +Inf, with sum and count.

    All bounds are counted in one aggregation; values never move between nodes. The sum is of whole billionths, so
    that it does not depend on the order of rows, and in decimals, as it soon exceeds a BIGINT.
    """
    keys = keys or []
    v: Column = F.col(value)
    counts = [F.count_if(v <= F.lit(float(b))).alias(f"_b{i}") for i, b in enumerate(bounds)]
    billionths = F.sum(F.round(v * 1e9).cast("bigint").cast("decimal(20,0)"))
    totals = df.groupBy(*keys).agg(
        *counts, (F.coalesce(billionths.cast("double"), F.lit(0.0)) / 1e9).alias("sum"), F.count(v).alias("count")
    )
    rows = F.array(
        *[
            F.struct(F.lit(_bound_text(b)).alias("le"), F.col(f"_b{i}").alias("cumulative"))
            for i, b in enumerate(bounds)
        ],
        F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("cumulative")),
    )
    return totals.select(*keys, F.inline(rows), "sum", "count")


def _bound_text(bound: float) -> str:
    return f"{bound:.6f}".rstrip("0").rstrip(".")


def interval_histogram(packets: DataFrame, bounds: list[float] | None = None, **options) -> DataFrame:
    return histogram(request_intervals(packets, **options), "seconds", bounds or INTERVAL_BOUNDS)


def latency_histogram(packets: DataFrame, bounds: list[float] | None = None, **options) -> DataFrame:
    return histogram(pair_latency(packets, **options), "seconds", bounds or LATENCY_BOUNDS)
