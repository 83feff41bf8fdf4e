"""Alert rules over metric samples, evaluated at every tick.

Query, threshold, no-data policy and holding time in one plan for any number of
series. State is 'normal', 'pending', 'firing' or 'nodata'.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalens.functions.slices import with_halo
from stratalens.operators.samples import (
    LOOKBACK_S,
    compare,
    count_or_zero,
    filter_value,
    increase,
    instant,
    select_series,
    with_series,
)

TICK_S = 60


@dataclass(frozen=True)
class Rule:
    name: str
    metric: str
    query: str  # 'value', 'abs', 'count_equal' or 'rate'
    op: str
    threshold: float
    for_s: int
    no_data: str  # 'alerting' or 'nodata'
    severity: str
    window_s: int = 300
    equal_to: float = 1.0


# Expression, threshold, holding time and policies of each rule.
RULES = {
    r.name: r
    for r in [
        Rule("source_down", "chrony_up", "value", "<", 1, 300, "alerting", "critical"),
        Rule("offset_high", "chrony_tracking_system_time_seconds", "abs", ">", 0.01, 600, "nodata", "critical"),
        Rule("no_reachable_source", "chrony_sources_reachability_ratio", "count_equal", "<", 1, 600, "alerting", "warning"),
        Rule("geo_not_loaded", "ntp_geoip_database_loaded", "value", "<", 1, 3600, "nodata", "warning"),
        Rule("kernel_drops", "ntp_capture_kernel_drops_total", "rate", ">", 0, 900, "nodata", "warning"),
        Rule("capture_down", "ntp_clients_scrape_success", "value", "<", 1, 300, "alerting", "warning"),
        Rule("pool_score_low", "ntppool_score", "value", "<", 10, 900, "nodata", "warning"),
    ]
}

WATCHED_INCREASE = "chrony_serverstats_client_log_records_dropped_total"
WATCHED_RATES = [
    "chrony_serverstats_ntp_packets_received_total",
    "chrony_serverstats_ntp_packets_dropped_total",
    "ntp_capture_kernel_drops_total",
]


def query_values(
    rule: Rule, samples: DataFrame, ticks: DataFrame, step: int = TICK_S,
    lookback: int = LOOKBACK_S, window: int | None = None,
) -> DataFrame:
    """(series, tick, value) of the rule's expression, at the given ticks only."""
    chosen = with_series(select_series(samples, rule.metric))
    if rule.query == "rate":
        values = increase(chosen, window or rule.window_s, step, ["series"]).select(
            "series", "tick", F.col("rate").alias("value")
        )
    else:
        values = instant(chosen, step, lookback, ["series"])
    values = values.join(ticks, "tick", "left_semi")
    if rule.query == "abs":
        values = values.withColumn("value", F.abs("value"))
    if rule.query == "count_equal":
        counted = count_or_zero(filter_value(values, "==", rule.equal_to), ticks)
        values = counted.withColumn("series", F.lit(""))
    return values.select("series", "tick", "value")


def apply_no_data(values: DataFrame, ticks: DataFrame, policy: str) -> DataFrame:
    """Add rows with an empty series at ticks where the query gave nothing.

    ``breach`` is NULL in those rows for the separate no-data state, true where
    the policy is to alert.
    """
    silent = ticks.join(values.select("tick").distinct(), "tick", "left_anti")
    breach = F.lit(True) if policy == "alerting" else F.lit(None).cast("boolean")
    return values.unionByName(
        silent.select(
            F.lit("").alias("series"), "tick", F.lit(None).cast("double").alias("value"), breach.alias("breach")
        )
    )


def alert_state(evals: DataFrame, for_s: int, step: int = TICK_S) -> DataFrame:
    """Firing once every evaluation of the last ``for_s`` seconds was a breach.

    A breach that held for that long shows as one breach per tick in a look back
    of fixed length, which also restarts the clock at a gap in the ticks.
    """
    needed = -(-for_s // step)
    look = needed * step
    window = W.partitionBy("series", "_slice").orderBy("tick").rangeBetween(-look, 0)
    held = with_halo(evals, "tick", look).withColumn("_n", F.count_if("breach").over(window))
    state = (
        F.when(F.col("breach").isNull(), "nodata")
        .when(~F.col("breach"), "normal")
        .when(F.col("_n") == needed + 1, "firing")
        .otherwise("pending")
    )
    return held.where(F.col("_slice") == F.col("_own")).withColumn("state", state).drop("_own", "_slice", "_n")


def evaluate(
    rule: Rule, samples: DataFrame, ticks: DataFrame, step: int = TICK_S,
    lookback: int = LOOKBACK_S, window: int | None = None, for_s: int | None = None,
) -> DataFrame:
    """State of the rule per series and tick."""
    values = query_values(rule, samples, ticks, step, lookback, window)
    judged = values.withColumn("breach", compare(F.col("value"), rule.op, rule.threshold))
    complete = apply_no_data(judged, ticks, rule.no_data)
    states = alert_state(complete, rule.for_s if for_s is None else for_s, step)
    return states.select(
        F.lit(rule.name).alias("rule"), F.lit(rule.severity).alias("severity"), "series", "tick", "value", "state"
    )


def watch_increase(samples: DataFrame, metric: str, window: int, step: int) -> DataFrame:
    """Ticks at which a counter that should stand still has grown."""
    grown = increase(with_series(select_series(samples, metric)), window, step)
    return grown.where(F.col("increase") > 0).select("metric", "series", "tick", "increase")


def watched_rates(samples: DataFrame, metrics: list[str], window: int, step: int) -> DataFrame:
    chosen = with_series(samples.where(F.col("metric").isin(metrics)))
    return increase(chosen, window, step).select("metric", "series", "tick", "rate")
