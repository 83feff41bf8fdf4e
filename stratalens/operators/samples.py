"""Metric samples: selection, instant values, rates, retention and unions.

A sample is ``(metric, labels MAP, ts TIMESTAMP, value DOUBLE)``. Ticks are
epoch seconds on a regular grid of ``step`` seconds. ``keys`` name the columns
that identify a series, by default the metric and its labels as text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.functions.slices import carry_last, next_value
from stratalens.functions.timegrid import SECOND_US, ceil_to
from stratalens.operators.traffic import seed

SERIES_KEYS = ["metric", "series"]
LOOKBACK_S = 300
DAY_S = 86_400
DATABASES = ("country", "asn")

_COMPARE = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def series_text(labels: Column) -> Column:
    """Labels as one text, ordered by name: ``a=1,b=2``."""
    pairs = F.array_sort(F.map_entries(labels))
    return F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def with_series(samples: DataFrame) -> DataFrame:
    return samples.withColumn("series", series_text(F.col("labels")))


def with_host(samples: DataFrame, host: str) -> DataFrame:
    """The label every shipped sample carries; it replaces one of the same name."""
    kept = F.map_filter(F.col("labels"), lambda k, _: k != "host")
    return samples.withColumn("labels", F.map_concat(kept, F.create_map(F.lit("host"), F.lit(host))))


def select_series(
    samples: DataFrame, metric: str, eq: dict[str, str] | None = None, re: dict[str, str] | None = None
) -> DataFrame:
    """Samples of a metric whose labels match; patterns match the whole value.

    A missing label counts as the empty text.
    """
    tests = [F.col("metric") == metric]
    label = lambda k: F.coalesce(F.try_element_at("labels", F.lit(k)), F.lit(""))
    tests += [label(k) == v for k, v in (eq or {}).items()]
    tests += [label(k).rlike(f"^(?:{pattern})$") for k, pattern in (re or {}).items()]
    return samples.where(reduce(lambda a, b: a & b, tests))


def compare(value: Column, op: str, x: float) -> Column:
    return _COMPARE[op](value, F.lit(float(x)))


def filter_value(df: DataFrame, op: str, x: float) -> DataFrame:
    return df.where(compare(F.col("value"), op, x))


def tick_grid(df: DataFrame, ts_us: Column, step: int) -> DataFrame:
    """Every tick from the first at or after the oldest row to the one after the newest."""
    tick = ceil_to(_ceil_seconds(ts_us), step)
    return df.agg(F.min(tick).alias("_a"), F.max(tick).alias("_b")).select(
        F.explode(F.sequence("_a", "_b", F.lit(step).cast("bigint"))).alias("tick")
    )


def _ceil_seconds(ts_us: Column) -> Column:
    return F.call_function("div", ts_us + F.lit(SECOND_US - 1), F.lit(SECOND_US).cast("bigint"))


def _us(df: DataFrame) -> DataFrame:
    return df.withColumn("_us", F.unix_micros("ts"))


def _newest_per_tick(samples: DataFrame, keys: list[str], step: int) -> DataFrame:
    """At most one row per series and tick, reduced before the shuffle."""
    return (
        _us(samples)
        .withColumn("tick", ceil_to(_ceil_seconds(F.col("_us")), step))
        .groupBy(*keys, "tick")
        .agg(F.max(F.struct("_us", "value")).alias("_s"))
    )


def instant(
    samples: DataFrame, step: int, lookback: int = LOOKBACK_S, keys: list[str] | None = None
) -> DataFrame:
    """Newest value of each series in (tick - lookback, tick], at every tick.

    Samples first shrink to the newest one per series and tick, then each is
    offered to the few ticks it can reach.
    """
    keys = keys or SERIES_KEYS
    newest = _newest_per_tick(samples, keys, step)
    reach_us = F.col("_s._us") + F.lit(lookback * SECOND_US - 1)
    last = F.call_function("div", reach_us, F.lit(SECOND_US).cast("bigint"))
    reached = newest.where(F.col("tick") <= last).withColumn(
        "tick", F.explode(F.sequence(F.col("tick"), last, F.lit(step).cast("bigint")))
    )
    return reached.groupBy(*keys, "tick").agg(F.max("_s").alias("_s")).select(
        *keys, "tick", F.col("_s.value").alias("value")
    )


def counter_steps(samples: DataFrame, keys: list[str] | None = None, slice_s: int = DAY_S) -> DataFrame:
    """Growth since the series' previous sample; after a reset, the new value."""
    keys = keys or SERIES_KEYS
    lagged = carry_last(
        _us(samples), keys, "_us", ["value"], "value", "_prev", slice_s * SECOND_US, include_current=False
    )
    grown = F.when(F.col("value") >= F.col("_prev"), F.col("value") - F.col("_prev")).otherwise(F.col("value"))
    return lagged.where(F.col("_prev").isNotNull()).select(*keys, "_us", grown.alias("step_value"))


def increase(
    samples: DataFrame, window: int, step: int, keys: list[str] | None = None, slice_s: int = DAY_S
) -> DataFrame:
    """Counter growth over (tick - window, tick] and the per-second rate."""
    keys = keys or SERIES_KEYS
    moves = counter_steps(samples, keys, slice_s)
    first = ceil_to(_ceil_seconds(F.col("_us")), step)
    reach_us = F.col("_us") + F.lit(window * SECOND_US - 1)
    last = F.call_function("div", reach_us, F.lit(SECOND_US).cast("bigint"))
    spans = (
        moves.select(*keys, first.alias("_first"), last.alias("_last"), "step_value")
        .where(F.col("_first") <= F.col("_last"))
        .groupBy(*keys, "_first", "_last")
        .agg(F.sum("step_value").alias("step_value"))
    )
    return (
        spans.withColumn("tick", F.explode(F.sequence("_first", "_last", F.lit(step).cast("bigint"))))
        .groupBy(*keys, "tick")
        .agg(F.sum("step_value").alias("increase"))
        .withColumn("rate", F.col("increase") / F.lit(float(window)))
    )


def rate(samples: DataFrame, window: int, step: int, keys: list[str] | None = None) -> DataFrame:
    keys = keys or SERIES_KEYS
    return increase(samples, window, step, keys).select(*keys, "tick", F.col("rate").alias("value"))


def sum_rate(samples: DataFrame, window: int, step: int) -> DataFrame:
    """Rates summed over all series of the input."""
    return rate(samples, window, step).groupBy("tick").agg(F.sum("value").alias("value"))


def country_map(samples: DataFrame, window: int, step: int) -> DataFrame:
    """Rate per country label, all other labels summed away."""
    labelled = with_series(samples).withColumn("country", F.try_element_at("labels", F.lit("country")))
    keyed = rate(labelled.where(F.col("country").isNotNull()), window, step, [*SERIES_KEYS, "country"])
    return keyed.groupBy("country", "tick").agg(F.sum("value").alias("value"))


def sensor_temps(samples: DataFrame, metric: str, chip: str) -> DataFrame:
    """Newest value of each series whose chip label matches the pattern."""
    chosen = with_series(select_series(samples, metric, re={"chip_name": chip}))
    return chosen.groupBy("series").agg(F.max(F.struct("ts", "value")).alias("_s")).select(
        "series", F.unix_micros("_s.ts").alias("ts_us"), F.col("_s.value").alias("value")
    )


def count_or_zero(df: DataFrame, ticks: DataFrame) -> DataFrame:
    """Rows per tick, 0 at ticks without any."""
    counts = df.groupBy("tick").agg(F.count("*").alias("_n"))
    return ticks.join(counts, "tick", "left").select(
        "tick", F.coalesce("_n", F.lit(0)).cast("double").alias("value")
    )


def or_else(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """All of ``a``, and those of ``b`` that ``a`` has no row for."""
    return a.unionByName(b.join(a.select(*on), on, "left_anti").select(*a.columns))


def counter_delta(readings: DataFrame, keys: list[str] | None = None, slice_s: int = DAY_S) -> DataFrame:
    """Growth of a running total between readings; a fall counts as 0, the first
    reading from 0."""
    keys = keys or []
    lagged = carry_last(
        _us(readings), keys, "_us", ["total"], "total", "_prev", slice_s * SECOND_US, include_current=False
    )
    grown = F.greatest(F.col("total") - F.coalesce("_prev", F.lit(0)), F.lit(0))
    return lagged.select(*keys, F.col("_us").alias("ts_us"), "total", grown.alias("delta"))


def retained_intervals(
    gauges: DataFrame, keys: list[str], step: int, until: Column, slice_s: int = DAY_S
) -> DataFrame:
    """(keys, valid_from, valid_to, value): a gauge keeps the last value set from its tick to the last tick before the
    series' next one, or to ``until``.

    NULL values set nothing. Settings shrink to the last per series and tick first. A row per setting, whatever the
    number of ticks; a series is cut into time slices.
    """
    newest = _newest_per_tick(gauges.where(F.col("value").isNotNull()), keys, step)
    followed = next_value(newest, keys, "tick", "tick", "_follow", slice_s)
    return followed.select(
        *keys,
        F.col("tick").alias("valid_from"),
        F.coalesce(F.col("_follow") - step, until).alias("valid_to"),
        F.col("_s.value").alias("value"),
    ).where(F.col("valid_from") <= F.col("valid_to"))


def at_ticks(intervals: DataFrame, step: int) -> DataFrame:
    """Intervals as one row per tick, for a sink that takes samples."""
    ticks = F.explode(F.sequence(F.col("valid_from"), F.col("valid_to"), F.lit(step).cast("bigint")))
    kept = [c for c in intervals.columns if c not in ("valid_from", "valid_to", "value")]
    return intervals.select(*kept, ticks.alias("tick"), "value")


def value_at(intervals: DataFrame, at: Column) -> DataFrame:
    """The values that hold at one instant, without a row for any other tick."""
    return intervals.where((F.col("valid_from") <= at) & (at <= F.col("valid_to"))).drop("valid_from", "valid_to")


def retain(gauges: DataFrame, keys: list[str], step: int, until: Column) -> DataFrame:
    """``retained_intervals`` at every tick."""
    return at_ticks(retained_intervals(gauges, keys, step, until), step)


def geo_loaded(timeline: DataFrame, ticks: DataFrame, step: int, until: Column) -> DataFrame:
    """1 at ticks where a readable table version is in use, else 0, for each table."""
    first = ceil_to(F.col("valid_from"), step)
    last = F.coalesce(F.col("valid_to") - 1, until)
    loaded = (
        timeline.where(F.col("readable") & (first <= last))
        .select(
            F.explode(F.sequence(first, last, F.lit(step).cast("bigint"))).alias("tick"),
            "db",
            F.lit(1).alias("value"),
        )
        .join(ticks, "tick", "left_semi")
    )
    nothing = ticks.select("tick", F.lit(None).cast("string").alias("db"), F.lit(0).alias("value"))
    seeded = seed(loaded.distinct().unionByName(nothing), ["tick"], "db", DATABASES, "value")
    return seeded.select("tick", "db", F.col("value").cast("double").alias("value"))


def family_samples(
    df: DataFrame, metric: str, value: str, tick: str, labels: dict[str, str] | None = None
) -> DataFrame:
    """A typed result as samples; ``labels`` maps label name to column."""
    pairs = [p for name, column in (labels or {}).items() for p in (F.lit(name), F.col(column).cast("string"))]
    mapped = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return df.select(
        F.lit(metric).alias("metric"),
        mapped.alias("labels"),
        F.timestamp_seconds(F.col(tick)).alias("ts"),
        F.col(value).cast("double").alias("value"),
    )


def all_samples(*families: DataFrame) -> DataFrame:
    """All metric families as one set of samples."""
    return reduce(lambda a, b: a.unionByName(b), families)
