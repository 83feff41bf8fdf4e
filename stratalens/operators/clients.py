"""Active clients, request intervals and the daily distinct-count sketch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalens.functions import sketch
from stratalens.functions.slices import lag_within, running_sum, with_halo
from stratalens.functions.timegrid import SECOND_NS, ceil_to, floor_to, seconds_of
from stratalens.operators.traffic import FLUSH_S

ACTIVE_WINDOW_S = 300
HOUR_S = 3600
SKETCH_HOURS = 24
DAY_S = 86_400


def _requests(packets: DataFrame) -> DataFrame:
    return packets.where(F.col("direction") == "request")


def _ceil_seconds(ts_ns: Column) -> Column:
    """First whole second at or after the packet."""
    return seconds_of(ts_ns + F.lit(SECOND_NS - 1))


def active_clients(
    packets: DataFrame, window: int = ACTIVE_WINDOW_S, every: int = FLUSH_S, slice_s: int = DAY_S
) -> DataFrame:
    """Distinct request addresses seen in [tick - window, tick], at every tick.

    A request keeps its client active from the next tick up to the last tick
    within the window. Requests collapse to one row per client and such span
    before the shuffle, so the rows per client are bounded by the ticks. Spans
    of one client merge by cutting each at the next span's start, which only
    matters within the window, so time slices of a client are cut apart; what is
    left adds +1 and -1 per tick and sums up over the ticks.
    """
    spans = (
        _requests(packets)
        .select(
            "client_ip",
            ceil_to(_ceil_seconds(F.col("ts_ns")), every).alias("enter"),
            floor_to(seconds_of(F.col("ts_ns")) + window, every).alias("leave"),
        )
        .where(F.col("enter") <= F.col("leave"))
        .groupBy("client_ip", "enter")
        .agg(F.max("leave").alias("leave"))
    )
    followed = lag_within(
        spans.withColumn("_back", -F.col("enter")), ["client_ip"], "_back", [], {"_next": "enter"}, window + every
    )
    cut = F.coalesce(F.col("_next") - every, F.col("leave"))
    disjoint = followed.withColumn("leave", F.least(F.col("leave"), cut))
    edges = F.array(
        F.struct(F.col("enter").alias("tick"), F.lit(1).cast("bigint").alias("step")),
        F.struct((F.col("leave") + every).alias("tick"), F.lit(-1).cast("bigint").alias("step")),
    )
    steps = disjoint.select(F.inline(edges)).groupBy("tick").agg(F.sum("step").alias("step"))
    ticks = steps.agg(F.min("tick").alias("_a"), F.max("tick").alias("_b")).select(
        F.explode(F.sequence("_a", "_b", F.lit(every).cast("bigint"))).alias("tick")
    )
    filled = ticks.join(steps, "tick", "left")
    return running_sum(filled, [], "tick", [], F.coalesce("step", F.lit(0)), "active", slice_s).select(
        "tick", "active"
    )


def request_intervals(
    packets: DataFrame, window: int = ACTIVE_WINDOW_S, every: int = FLUSH_S
) -> DataFrame:
    """Seconds since the client's previous request, unless it was evicted in between.

    A client is evicted at the last flush before this request if its previous
    request was already older than the window by then.
    """
    horizon = (window + every) * SECOND_NS
    lagged = lag_within(
        _requests(packets).select("seq", "ts_ns", "client_ip"),
        ["client_ip"], "ts_ns", ["seq"], {"_prev": "ts_ns"}, horizon,
    )
    last_flush = floor_to(F.col("ts_ns"), every * SECOND_NS)
    return lagged.where(F.col("_prev") >= last_flush - window * SECOND_NS).select(
        "seq", "ts_ns", "client_ip", ((F.col("ts_ns") - F.col("_prev")) / SECOND_NS).alias("seconds")
    )


def hll_registers(df: DataFrame, key: str, keys: list[str] | None = None, p: int = sketch.DEFAULT_P) -> DataFrame:
    """Sketch as rows: register ``idx`` and its maximum rank ``rho``, per ``keys``.

    At most 2^p rows per group whatever the input, thanks to partial maxima.
    """
    keys = keys or []
    return (
        df.select(
            *keys,
            sketch.register_index(F.col(key), p).alias("idx"),
            sketch.register_rank(F.col(key), p).alias("rho"),
        )
        .groupBy(*keys, "idx")
        .agg(F.max("rho").alias("rho"))
        .withColumn("p", F.lit(p))
    )


def _one_precision() -> Column:
    """The largest rank, which cannot be read without checking that the group's sketches have one precision."""
    return F.when(F.min("p") == F.max("p"), F.max("rho")).otherwise(
        F.raise_error(F.lit("cannot merge sketches of different precision"))
    ).cast("int")


def hll_merge(registers: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Register-wise maximum; fails when the sketches of a group differ in precision.

    Sketches of different precision need not share a register, so the group's precision goes along with every row.
    """
    keys = keys or []
    by_group = registers.groupBy(*keys).agg(F.min("p").alias("_lo"), F.max("p").alias("_hi"))
    merged = registers.groupBy(*keys, "idx").agg(_one_precision().alias("rho"))
    joined = merged.join(by_group, keys) if keys else merged.crossJoin(F.broadcast(by_group))  # one row
    whole = F.when(F.col("_lo") == F.col("_hi"), F.col("rho")).otherwise(
        F.raise_error(F.lit("cannot merge sketches of different precision"))
    )
    return joined.select(*keys, "idx", whole.cast("int").alias("rho"), F.col("_hi").alias("p"))


def hll_estimate(registers: DataFrame, keys: list[str] | None = None, out: str = "estimate") -> DataFrame:
    """Distinct-count estimate per group; absent registers count as 0, empty is 0.

    The precision is the registers' own; a group of several precisions fails.
    """
    keys = keys or []
    sums = registers.groupBy(*keys).agg(
        F.sum(F.pow(F.lit(2.0), -F.col("rho"))).alias("_inv"), F.count("*").alias("_n"),
        F.min("p").alias("_lo"), F.max("p").alias("_hi"),
    )
    return sums.select(*keys, _estimate_of_one_precision().alias(out))


def _estimate_of_one_precision() -> Column:
    """Estimate from _inv and _n, by the precision that _lo and _hi agree on."""
    by_p = F.lit(None).cast("double")
    for p in range(sketch.MIN_P, sketch.MAX_P + 1):
        by_p = F.when(F.col("_hi") == p, sketch.estimate(F.col("_inv"), F.col("_n"), p)).otherwise(by_p)
    mixed = F.raise_error(F.lit("cannot merge sketches of different precision")).cast("double")
    return F.when(F.col("_n") == 0, 0.0).when(F.col("_lo") == F.col("_hi"), by_p).otherwise(mixed)


def hourly_registers(packets: DataFrame, p: int = sketch.DEFAULT_P) -> DataFrame:
    hourly = _requests(packets).withColumn("hour", floor_to(seconds_of(F.col("ts_ns")), HOUR_S))
    return hll_registers(hourly, "client_ip", ["hour"], p)


def daily_from_registers(
    registers: DataFrame, hours: int = SKETCH_HOURS, hold: Callable[[DataFrame], DataFrame] = lambda table: table,
) -> DataFrame:
    """Union of each hour's sketch and the ``hours - 1`` before it, then its estimate.

    A register's maximum over the hours only changes where a rank enters or
    leaves, so a register row makes two moves, whatever the hours. Their steps in
    the sum of 2^-rank (as whole multiples of 2^-61, so that sums are exact) and
    in the number of registers add up by hour and then over the hours. The moves
    of a register are cut into time slices: what it held before a move is known
    from the span before it, and that from the span before that. The sums read
    their input several times; ``hold`` may persist it, a row per hour.
    """
    span = hours * HOUR_S
    moves = registers.select("idx", "hour", "rho").unionByName(
        registers.select("idx", (F.col("hour") + span).alias("hour"), F.lit(None).cast("int").alias("rho"))
    )
    moves = with_halo(moves.groupBy("idx", "hour").agg(F.max("rho").alias("rho")), "hour", 2 * span)
    window = W.partitionBy("idx", "_slice").orderBy("hour")
    moves = moves.withColumn("_now", F.max("rho").over(window.rangeBetween(-(span - HOUR_S), 0)))
    moves = moves.withColumn("_was", F.lag("_now").over(window)).where(F.col("_slice") == F.col("_own"))

    def part(rank: str) -> Column:
        return F.coalesce(F.expr(f"shiftleft(1L, 61 - {rank})"), F.lit(0)).cast("decimal(20,0)")

    steps = moves.groupBy("hour").agg(
        F.sum(part("_now") - part("_was")).alias("_part"),
        F.sum(F.col("_now").isNotNull().cast("bigint") - F.col("_was").isNotNull().cast("bigint")).alias("_step"),
    )
    reached = registers.groupBy("hour").agg(F.min("p").alias("_lo"), F.max("p").alias("_hi")).select(
        "_lo", "_hi", "hour", F.explode(F.sequence(F.lit(0), F.lit(hours))).alias("_after")
    )
    live = F.col("_after") < hours
    ticks = reached.groupBy((F.col("hour") + F.col("_after") * HOUR_S).alias("hour")).agg(
        F.min(F.when(live, F.col("_lo"))).alias("_lo"), F.max(F.when(live, F.col("_hi"))).alias("_hi")
    )
    summed = running_sum(hold(ticks.join(steps, "hour", "left")), [], "hour", [], "_step", "_n", 31 * DAY_S)
    summed = running_sum(summed, [], "hour", [], "_part", "_parts", 31 * DAY_S, "decimal(38,0)")
    inverse = F.col("_parts").cast("double") / float(1 << 61)
    return summed.where(F.col("_n") > 0).withColumn("_inv", inverse).select(
        "hour", _estimate_of_one_precision().alias("unique_clients")
    )


def unique_daily(packets: DataFrame, hours: int = SKETCH_HOURS, p: int = sketch.DEFAULT_P) -> DataFrame:
    """Estimated distinct clients per hour over that hour and the 23 before it."""
    return daily_from_registers(hourly_registers(packets, p), hours)
