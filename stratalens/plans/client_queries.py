"""Clients, intervals, pairing, histograms and distinct-count sketches."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.operators import clients, latency
from stratalens.plans.inputs import ACTIVE_WINDOW, FLUSH, TTL, Inputs
from stratalens.plans.registry import query

INTERVAL_BOUNDS = [600.0, 3600.0, 7200.0, 14400.0, 28800.0, 86400.0]
LATENCY_BOUNDS = [600.0, 1800.0, 3600.0, 7200.0, 21600.0, 43200.0]
PENDING_CAP = 20

ESTIMATE = """CASE WHEN raw <= 40960 AND n < 16384 THEN 16384.0::DOUBLE * ln(16384.0::DOUBLE / (16384 - n)) ELSE raw END"""
RAW = "0.7213::DOUBLE / (1.0::DOUBLE + 1.079::DOUBLE / 16384) * 16384 * 16384 / (sum(pow(2.0::DOUBLE, -rho)) + 16384 - count(*)) AS raw, count(*) AS n"


def _histogram_sql(source: str, bounds: list[float]) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{b:g}' AS le, count(*) FILTER (seconds <= {b}) AS cumulative, sum, count FROM h GROUP BY sum, count" for b in bounds
    )
    return f"""
SELECT le, cumulative, CAST(sum AS BIGINT) / 1e9 AS sum, count FROM (
  {rows.replace("FROM h", f"FROM (SELECT seconds, sum(CAST(round(seconds * 1e9) AS BIGINT)) OVER () AS sum, count(*) OVER () AS count FROM {source})")}
  UNION ALL SELECT '+Inf', count(*), sum(CAST(round(seconds * 1e9) AS BIGINT)), count(*) FROM {source})"""


@query("win_1_intervals", "SELECT seq, ts_ns, client_ip, seconds FROM gaps")
def _(t: Inputs):
    return clients.request_intervals(t.packets, ACTIVE_WINDOW, FLUSH)


@query("win_2_pairing", "SELECT seq, ts_ns, client_ip, xid, request_ns, seconds FROM pairs")
def _(t: Inputs):
    return latency.pair_latency(t.packets, TTL).withColumn("xid", F.hex("xid"))


@query("win_9_pending_depth", f"""
SELECT r.seq, r.us * 1000 AS ts_ns, count(q.seq) AS depth,
  NOT coalesce(r.prev_dir = 'request' AND r.us - r.prev_us <= 43200000000, false) AND count(q.seq) >= {PENDING_CAP} AS overflow
FROM (SELECT * FROM ordered WHERE direction = 'request') r
LEFT JOIN (SELECT * FROM ordered WHERE direction = 'request') q
  ON q.us < r.us AND r.us - q.us <= 43200000000 AND (q.next_us IS NULL OR q.next_us >= r.us)
GROUP BY r.seq, r.us, r.prev_dir, r.prev_us""")
def _(t: Inputs):
    return latency.pending_depth(t.packets, PENDING_CAP, TTL).drop("shard")


@query("agg_8_active_clients", "SELECT tick, active FROM active")
def _(t: Inputs):
    return clients.active_clients(t.packets, ACTIVE_WINDOW, FLUSH)


@query("agg_9_registers", "SELECT hour, idx, rho FROM reg")
def _(t: Inputs):
    return clients.hourly_registers(t.packets).select("hour", "idx", "rho")


@query("agg_10_merge", "SELECT idx, max(rho) AS rho FROM reg GROUP BY idx")
def _(t: Inputs):
    return clients.hll_merge(clients.hourly_registers(t.packets)).select("idx", "rho")


@query("agg_11_estimate", f"SELECT hour, round({ESTIMATE}, 6) AS estimate FROM (SELECT hour, {RAW} FROM reg GROUP BY hour)")
def _(t: Inputs):
    return clients.hll_estimate(clients.hourly_registers(t.packets), ["hour"]).withColumn("estimate", F.round("estimate", 6))


@query("agg_12_unique_daily", f"""
SELECT hour, round({ESTIMATE}, 6) AS unique_clients FROM (SELECT hour, {RAW} FROM daily GROUP BY hour)""")
def _(t: Inputs):
    return clients.unique_daily(t.packets).withColumn("unique_clients", F.round("unique_clients", 6))


@query("win_10_hour_expiry", f"""
SELECT hour, round({ESTIMATE}, 6) AS unique_clients FROM (SELECT hour, {RAW} FROM (
  SELECT r.hour + h.k * 3600 AS hour, idx, max(rho) AS rho FROM reg r CROSS JOIN (SELECT unnest(generate_series(0, 2)) AS k) h
  GROUP BY ALL) GROUP BY hour)""")
def _(t: Inputs):
    """Sketches of an hour are out of the union three hours later."""
    return clients.unique_daily(t.packets, hours=3).withColumn("unique_clients", F.round("unique_clients", 6))


@query("set_3_sketch_union", """
SELECT idx, max(rho) AS rho FROM reg WHERE hour % 7200 = 0 GROUP BY idx
UNION ALL SELECT idx + 100000, max(rho) FROM reg GROUP BY idx""")
def _(t: Inputs):
    """Of the even hours, and of these and the odd ones together."""
    registers = clients.hourly_registers(t.packets)
    even = clients.hll_merge(registers.where("hour % 7200 = 0"))
    odd = clients.hll_merge(registers.where("hour % 7200 <> 0"))
    both = clients.hll_merge(even.unionByName(odd)).withColumn("idx", F.col("idx") + 100_000)
    return even.unionByName(both).select("idx", "rho")


@query("agg_13_histogram", _histogram_sql("(SELECT value AS seconds FROM ev)", [1.0, 5.0, 10.0, 50.0]))
def _(t: Inputs):
    return latency.histogram(t.timed, "value", [1.0, 5.0, 10.0, 50.0])


@query("agg_14_interval_histogram", _histogram_sql("gaps", INTERVAL_BOUNDS))
def _(t: Inputs):
    return latency.interval_histogram(t.packets, INTERVAL_BOUNDS, window=ACTIVE_WINDOW, every=FLUSH)


@query("agg_15_latency_histogram", _histogram_sql("pairs", LATENCY_BOUNDS))
def _(t: Inputs):
    return latency.latency_histogram(t.packets, LATENCY_BOUNDS, ttl=TTL)
