"""Alert rules at the scale of the test data: hourly ticks, three hours of look back and of holding."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.operators import alerts
from stratalens.plans.inputs import FLUSH, Inputs
from stratalens.plans.registry import query

LOOKBACK, WINDOW, HOLD = 10_800, 7200, 10_800

_VALUES = {
    "value": "SELECT series, tick, value FROM al_instant WHERE metric = '{metric}'",
    "abs": "SELECT series, tick, abs(value) AS value FROM al_instant WHERE metric = '{metric}'",
    "count_equal": """SELECT '' AS series, t.tick, CAST(count(v.tick) AS DOUBLE) AS value FROM ticks t
      LEFT JOIN (SELECT tick FROM al_instant WHERE metric = '{metric}' AND value = 1) v ON v.tick = t.tick GROUP BY t.tick""",
    "rate": "SELECT series, tick, value FROM al_rate",
}


def _judged(rule: alerts.Rule) -> str:
    values = _VALUES[rule.query].format(metric=rule.metric)
    silent = "true" if rule.no_data == "alerting" else "NULL"
    return f"""SELECT series, tick, value, value {rule.op} {rule.threshold} AS breach FROM ({values})
    UNION ALL SELECT '', tick, NULL, {silent} FROM ticks WHERE tick NOT IN (SELECT tick FROM ({values}))"""


def _state_sql(rule: alerts.Rule, hold: int = HOLD) -> str:
    return f"""
SELECT '{rule.name}' AS rule, '{rule.severity}' AS severity, series, tick, value,
  CASE WHEN breach IS NULL THEN 'nodata' WHEN NOT breach THEN 'normal'
    WHEN count(*) FILTER (breach) OVER (PARTITION BY series ORDER BY tick RANGE BETWEEN {hold} PRECEDING AND CURRENT ROW) = {hold // FLUSH + 1}
    THEN 'firing' ELSE 'pending' END AS state
FROM ({_judged(rule)})"""


def _evaluated(t: Inputs, rule: alerts.Rule, hold: int = HOLD):
    source = t.alert_counters if rule.query == "rate" else t.alert_samples
    return alerts.evaluate(rule, source, t.ticks, FLUSH, LOOKBACK, WINDOW, hold)


for _i, _rule in enumerate(alerts.RULES.values(), 1):
    query(f"alt_{_i}_{_rule.name}", _state_sql(_rule))(lambda t, rule=_rule: _evaluated(t, rule))

_UP = alerts.RULES["source_down"]


@query("win_7_alert_for", _state_sql(_UP, 4 * FLUSH))
def _(t: Inputs):
    """The holding time is a parameter: here four hours."""
    return _evaluated(t, _UP, 4 * FLUSH)


@query("alt_8_watch_increase", """
SELECT 'chrony_serverstats_client_log_records_dropped_total' AS metric, series, tick, increase FROM (
  SELECT s.series, t.tick, sum(s.step) AS increase FROM ctr_steps s JOIN ticks t
    ON s.us > (t.tick - 7200) * 1000000 AND s.us <= t.tick * 1000000 WHERE s.metric = 'signup' GROUP BY ALL) WHERE increase > 0""")
def _(t: Inputs):
    grown = alerts.watch_increase(t.alert_counters, alerts.WATCHED_INCREASE, WINDOW, FLUSH)
    return grown.join(t.ticks, "tick", "left_semi")


@query("alt_9_watched_rates", """
SELECT m.name AS metric, s.series, t.tick, sum(s.step) / 7200.0::DOUBLE AS rate FROM ctr_steps s JOIN ticks t
  ON s.us > (t.tick - 7200) * 1000000 AND s.us <= t.tick * 1000000
JOIN (VALUES ('click', 'chrony_serverstats_ntp_packets_received_total'), ('view', 'chrony_serverstats_ntp_packets_dropped_total'),
  ('error', 'ntp_capture_kernel_drops_total')) m(kind, name) ON m.kind = s.metric GROUP BY ALL""")
def _(t: Inputs):
    rates = alerts.watched_rates(t.alert_counters, alerts.WATCHED_RATES, WINDOW, FLUSH)
    return rates.join(t.ticks, "tick", "left_semi")


@query("alt_10_no_data", f"SELECT policy, series, tick, breach FROM (SELECT 'alerting' AS policy, * FROM ({_judged(_UP)})"
       f" UNION ALL SELECT 'nodata', * FROM ({_judged(_UP).replace('true', 'NULL')}))")  # fmt: skip
def _(t: Inputs):
    """Both policies on one query's values."""
    values = alerts.query_values(_UP, t.alert_samples, t.ticks, FLUSH, LOOKBACK)
    judged = values.withColumn("breach", alerts.compare(F.col("value"), _UP.op, _UP.threshold))
    both = [
        alerts.apply_no_data(judged, t.ticks, policy).select(F.lit(policy).alias("policy"), "series", "tick", "breach")
        for policy in ("alerting", "nodata")
    ]
    return both[0].unionByName(both[1])
