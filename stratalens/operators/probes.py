"""Load-probe statistics: matching, loss, achieved rate and percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.functions.slices import running_sum
from stratalens.functions.timegrid import SECOND_NS

LOSS_LIMIT_PERCENT = 1.0
RATE_FLOOR = 0.95
PERCENTILES = {"p50_us": 0.50, "p95_us": 0.95, "p99_us": 0.99}
RTT_SLICE_US = 1000


def match_probes(sends: DataFrame, replies: DataFrame) -> DataFrame:
    """Each send with its first reply; replies to unknown cookies match nothing."""
    first = replies.groupBy("worker", "cookie").agg(F.min("recv_ns").alias("recv_ns"))
    joined = sends.join(first, ["worker", "cookie"], "left")
    rtt = F.call_function("div", F.col("recv_ns") - F.col("sent_ns"), F.lit(1000).cast("bigint"))
    return joined.select("worker", "cookie", "sent_ns", "recv_ns", rtt.alias("rtt_us"))


def load_summary(matched: DataFrame, target_rate: float, duration_s: float | None = None) -> DataFrame:
    """One row: counts, loss, achieved rate and the two gates.

    ``duration_s`` is the sending time; without it, the span of the sends.
    """
    span = (F.max("sent_ns") - F.min("sent_ns")) / SECOND_NS
    elapsed = F.lit(float(duration_s)) if duration_s is not None else span
    totals = matched.agg(
        F.count("*").alias("sent"), F.count("recv_ns").alias("received"), elapsed.alias("_s")
    )
    loss = F.when(F.col("sent") > 0, 100.0 * (F.col("sent") - F.col("received")) / F.col("sent")).otherwise(0.0)
    rate = F.when(F.col("_s") > 0, F.col("sent") / F.col("_s")).otherwise(0.0)
    return totals.select(
        "sent", "received", loss.alias("loss_percent"), rate.alias("achieved_rate"),
        (loss > LOSS_LIMIT_PERCENT).alias("loss_failed"),
        (rate < RATE_FLOOR * target_rate).alias("rate_low"),
    )


def rtt_percentiles(matched: DataFrame) -> DataFrame:
    """Nearest-rank percentiles and maximum of the round trips, 0 when there are none.

    Times shrink to counts per microsecond before the shuffle and the ranks are
    a sliced running sum, so no task ever holds or sorts all replies.
    """
    counts = (
        matched.where(F.col("rtt_us").isNotNull()).groupBy("rtt_us").agg(F.count("*").alias("_n"))
    )
    ranked = running_sum(counts, [], "rtt_us", [], "_n", "_rank", RTT_SLICE_US)
    total = counts.agg(F.sum("_n")).scalar()
    first = lambda p: F.min(
        F.when(F.col("_rank") >= F.greatest(F.ceil(F.lit(p) * F.col("_total").cast("double")), F.lit(1)), F.col("rtt_us"))
    )
    return ranked.withColumn("_total", total).agg(
        *[F.coalesce(first(p), F.lit(0)).alias(name) for name, p in PERCENTILES.items()],
        F.coalesce(F.max("rtt_us"), F.lit(0)).alias("max_us"),
    )
