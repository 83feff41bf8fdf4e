"""Metric samples: selection, instant values, rates, unions; probes and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.operators import logs, probes, samples, traffic
from stratalens.plans.inputs import FLUSH, Inputs
from stratalens.plans.registry import query

LOOKBACK = 10_800
WINDOW = 7200


@query("fil_3_select_series", """
SELECT us, series, value FROM sms WHERE metric = 'click' AND host = 'h1' AND regexp_full_match(chip_name, 'cpu.*|nv.*')""")
def _(t: Inputs):
    chosen = samples.select_series(t.samples, "click", {"host": "h1"}, {"chip_name": "cpu.*|nv.*"})
    return samples.with_series(chosen).select(F.unix_micros("ts").alias("us"), "series", "value")


@query("fil_4_filter_value", "SELECT us, metric, value FROM sm WHERE value > 20")
def _(t: Inputs):
    return samples.filter_value(t.samples, ">", 20).select(F.unix_micros("ts").alias("us"), "metric", "value")


@query("joi_9_instant", """
SELECT metric, series, tick, value FROM (
  SELECT s.metric, s.series, t.tick, a.value, a.us FROM (SELECT DISTINCT metric, series FROM sms) s CROSS JOIN ticks t
  ASOF JOIN sms a ON a.metric = s.metric AND a.series = s.series AND t.tick * 1000000 >= a.us)
WHERE us > (tick - 10800) * 1000000""")
def _(t: Inputs):
    found = samples.instant(samples.with_series(t.samples), FLUSH, LOOKBACK)
    return found.join(t.ticks, "tick", "left_semi")


@query("win_3_counter_delta", """
SELECT us AS ts_us, total, greatest(total - coalesce(lag(total) OVER (ORDER BY us), 0), 0) AS delta FROM (
  SELECT us, count(*) OVER (PARTITION BY us // 86400000000 ORDER BY us) AS total FROM ev WHERE event_type = 'error')""")
def _(t: Inputs):
    return samples.counter_delta(t.drop_readings)


@query("win_6_rate", """
SELECT s.metric, s.series, t.tick, sum(s.step) AS increase, round(sum(s.step) / 7200.0, 9) AS rate
FROM ctr_steps s JOIN ticks t ON s.us > (t.tick - 7200) * 1000000 AND s.us <= t.tick * 1000000 GROUP BY ALL""")
def _(t: Inputs):
    grown = samples.increase(samples.with_series(t.counters), WINDOW, FLUSH).join(t.ticks, "tick", "left_semi")
    return grown.withColumn("rate", F.round("rate", 9))


@query("agg_18_count_or_zero", """
SELECT t.tick, CAST(count(v.tick) AS DOUBLE) AS value FROM ticks t LEFT JOIN (
  SELECT ((us + 3599999999) // 3600000000) * 3600 AS tick FROM sm WHERE value > 60) v ON v.tick = t.tick GROUP BY t.tick""")
def _(t: Inputs):
    tick = F.ceil(F.unix_micros("ts") / 3_600_000_000) * FLUSH
    return samples.count_or_zero(samples.filter_value(t.samples, ">", 60).select(tick.alias("tick")), t.ticks)


@query("agg_19_sum_rate", """
SELECT t.tick, round(sum(s.step), 3) AS value FROM ctr_steps s JOIN ticks t
  ON s.us > (t.tick - 7200) * 1000000 AND s.us <= t.tick * 1000000 GROUP BY t.tick""")
def _(t: Inputs):
    total = samples.sum_rate(samples.with_series(t.counters), WINDOW, FLUSH).join(t.ticks, "tick", "left_semi")
    return total.withColumn("value", F.round(F.col("value") * WINDOW, 3))


@query("agg_23_country_map", """
SELECT country, tick, round(sum(step), 3) AS value FROM (
  SELECT country, t.tick, CASE WHEN value >= prev THEN value - prev ELSE value END AS step
  FROM (SELECT *, lag(value) OVER (PARTITION BY metric, series ORDER BY us, value) AS prev FROM sms) s
  JOIN ticks t ON s.us > (t.tick - 7200) * 1000000 AND s.us <= t.tick * 1000000 WHERE prev IS NOT NULL) GROUP BY ALL""")
def _(t: Inputs):
    mapped = samples.country_map(t.samples, WINDOW, FLUSH).join(t.ticks, "tick", "left_semi")
    return mapped.withColumn("value", F.round(F.col("value") * WINDOW, 3))


@query("agg_24_sensor_values", """
SELECT series, us AS ts_us, value FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY us DESC, value DESC) AS rn
  FROM sms WHERE metric = 'view' AND chip_name IN ('cpu_thermal', 'nvme')) WHERE rn = 1""")
def _(t: Inputs):
    return samples.sensor_temps(t.samples, "view", "cpu_thermal|nvme")


@query("set_1_all_samples", """
SELECT 'ntp_requests' AS metric, 'country=' || country AS series, flush AS tick, CAST(count(*) AS DOUBLE) AS value
FROM pc WHERE direction = 'request' GROUP BY ALL
UNION ALL SELECT 'ntp_packets', 'direction=' || direction, flush, CAST(count(*) AS DOUBLE) FROM pk GROUP BY ALL""")
def _(t: Inputs):
    from stratalens.operators import enrich

    requests = traffic.requests_by_country(enrich.enrich_country(t.packets, t.geo_country), FLUSH)
    requests = requests.groupBy("flush", "country").agg(F.sum("requests").alias("requests"))
    packets = traffic.packets_by_direction(t.packets, FLUSH).where("packets > 0")
    both = samples.all_samples(
        samples.family_samples(requests, "ntp_requests", "requests", "flush", {"country": "country"}),
        samples.family_samples(packets, "ntp_packets", "packets", "flush", {"direction": "direction"}),
    )
    return samples.with_series(both).select("metric", "series", F.unix_seconds("ts").alias("tick"), "value")


@query("set_2_or", """
SELECT us, series, value FROM sms WHERE metric = 'click'
UNION ALL SELECT us, series, value FROM sms s WHERE metric = 'view'
  AND NOT EXISTS (SELECT 1 FROM sms c WHERE c.metric = 'click' AND c.series = s.series)""")
def _(t: Inputs):
    rows = samples.with_series(t.samples).select("metric", F.unix_micros("ts").alias("us"), "series", "value")
    pick = lambda m: rows.where(F.col("metric") == m).drop("metric")
    return samples.or_else(pick("click"), pick("view"), ["series"])


@query("joi_10_probe_match", "SELECT worker, cookie, sent_ns, recv_ns, rtt_us FROM matched")
def _(t: Inputs):
    return probes.match_probes(t.sends, t.replies)


@query("agg_16_load_summary", """
SELECT sent, received, round(loss, 6) AS loss_percent, round(rate, 6) AS achieved_rate, loss > 1.0 AS loss_failed, rate < 0.95 * 0.01 AS rate_low
FROM (SELECT sent, received, 100.0::DOUBLE * (sent - received) / sent AS loss, sent / span AS rate FROM (
  SELECT count(*) AS sent, count(recv_ns) AS received, (max(sent_ns) - min(sent_ns)) / 1e9::DOUBLE AS span FROM matched))""")
def _(t: Inputs):
    row = probes.load_summary(probes.match_probes(t.sends, t.replies), 0.01)
    return row.withColumns({c: F.round(c, 6) for c in ("loss_percent", "achieved_rate")})


@query("agg_17_percentiles", """
SELECT max(rtt_us) FILTER (r = greatest(ceil(0.50::DOUBLE * n), 1)) AS p50_us, max(rtt_us) FILTER (r = greatest(ceil(0.95::DOUBLE * n), 1)) AS p95_us,
  max(rtt_us) FILTER (r = greatest(ceil(0.99::DOUBLE * n), 1)) AS p99_us, max(rtt_us) AS max_us
FROM (SELECT rtt_us, row_number() OVER (ORDER BY rtt_us) AS r, count(*) OVER () AS n FROM matched WHERE rtt_us IS NOT NULL)""")
def _(t: Inputs):
    return probes.rtt_percentiles(probes.match_probes(t.sends, t.replies))


def _labelled(t: Inputs):
    rules = logs.container_rules(["c-click", "c-view", "c-error"], "containers", "edge-1")
    return logs.relabel(t.logs, rules)


@query("fil_5_select_logs", """
SELECT us, container_name, host, msg FROM lg WHERE container_name = '/c-click' AND regexp_full_match(host, 'h[12]') AND regexp_matches(msg, '(?i)"K": 1')""")
def _(t: Inputs):
    found = logs.select_logs(t.logs, {"container_name": "/c-click"}, "h[12]", '"K": 1')
    return found.select(F.unix_micros("ts").alias("us"), "container_name", "host", "msg")


@query("fil_6_relabel", """
SELECT us, substr(container_name, 2) AS container_name, 'edge-1' AS host, 'containers' AS job FROM lg
WHERE container_name IN ('/c-click', '/c-view', '/c-error')""")
def _(t: Inputs):
    return _labelled(t).select(F.unix_micros("ts").alias("us"), "container_name", "host", "job")


@query("fil_7_time_range", "SELECT us, container_name FROM lg WHERE us > (SELECT max(us) FROM ev) - 21600000000")
def _(t: Inputs):
    now = t.timed.agg(F.max("ts")).scalar()
    return logs.last(t.logs, "6 hours", now).select(F.unix_micros("ts").alias("us"), "container_name")


@query("agg_20_log_volume", """
SELECT (us // 3600000000) * 3600 AS bucket, container_name, count(*) AS count FROM lg GROUP BY ALL""")
def _(t: Inputs):
    return logs.log_volume(t.logs, FLUSH)


@query("agg_21_legend_total", "SELECT container_name, count(*) AS total FROM lg GROUP BY ALL")
def _(t: Inputs):
    return logs.series_total(logs.log_volume(t.logs, FLUSH))


@query("top_3_log_listing", "SELECT us, container_name, host, msg FROM lg ORDER BY us DESC LIMIT 50")
def _(t: Inputs):
    return logs.list_logs(t.logs, 50).select(F.unix_micros("ts").alias("us"), "container_name", "host", "msg")


@query("top_4_field_values", "SELECT DISTINCT container_name FROM lg ORDER BY 1 LIMIT 1000")
def _(t: Inputs):
    return logs.field_values(t.logs, "container_name")
