"""Score documents: parsing, newest entries, polls and gauges."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.operators import pool
from stratalens.operators.samples import retain
from stratalens.plans.inputs import FLUSH, Inputs
from stratalens.plans.registry import query


def _us():
    return F.unix_micros("poll_ts").alias("us")


def _parsed(t: Inputs, kind: str | None = None):
    docs = t.score_docs if kind is None else t.score_docs.where(F.col("kind") == kind)
    return pool.parse_docs(docs)


@query("pool_1_parse", """
SELECT ip, d.us, 'monitors' AS kind, monitors_ok AS ok, CASE WHEN monitors_ok THEN n ELSE 0 END AS entries,
  CASE WHEN monitors_ok THEN 6 ELSE 0 END AS names
FROM pd d JOIN (SELECT poll, count(*) AS n FROM pe GROUP BY poll) c ON c.poll = d.poll
UNION ALL SELECT ip, d.us, 'overall', true, n, 0
FROM pd d JOIN (SELECT poll, count(*) AS n FROM pe GROUP BY poll) c ON c.poll = d.poll WHERE has_overall""")
def _(t: Inputs):
    entries, names = (F.size(c).cast("bigint").alias(n) for c, n in (("history", "entries"), ("monitors", "names")))
    return _parsed(t).select("ip", _us(), "kind", "ok", entries, names.cast("int").alias("names"))


@query("pool_2_time_order", """
SELECT ip, us, CAST(event_id % 16 AS INTEGER) AS pos FROM (SELECT *, row_number() OVER (
    PARTITION BY poll ORDER BY ts_rank DESC, coarse DESC, event_id) AS rn FROM (SELECT poll, ts_rank, coarse, event_id FROM pe)) e
  JOIN (SELECT poll AS p, ip, us FROM pd WHERE has_overall) ON p = poll WHERE rn = 1""")
def _(t: Inputs):
    """Where the newest entry stands in each overall document."""
    rows = _parsed(t, "overall").select("ip", "poll_ts", F.explode("history").alias("e"))
    newest = rows.groupBy("ip", "poll_ts").agg(F.max_by(F.col("e.pos"), pool.ts_sort_key(F.col("e"))).alias("pos"))
    return newest.select("ip", _us(), "pos")


@query("pool_3_overall_score", "SELECT ip, us, n.score FROM pd d JOIN newest n ON n.poll = d.poll WHERE has_overall")
def _(t: Inputs):
    return pool.overall_score(_parsed(t, "overall")).select("ip", _us(), "score")


@query("pool_4_latest_by_monitor", """
SELECT ip, d.us, monitor_id, score, value AS "offset", value AS rtt FROM latest l JOIN pd d ON d.poll = l.poll WHERE monitors_ok""")
def _(t: Inputs):
    return pool.latest_by_monitor(_parsed(t, "monitors")).select("ip", _us(), "monitor_id", "score", "offset", "rtt")


@query("joi_7_monitor_names", """
SELECT ip, us, m.id AS monitor_id, CASE WHEN m.id = 5 THEN '5' ELSE 'mon-' || CAST(m.id AS VARCHAR) END AS name
FROM pd CROSS JOIN (SELECT unnest(generate_series(0, 5)) AS id) m WHERE monitors_ok""")
def _(t: Inputs):
    return pool.monitor_names(_parsed(t, "monitors")).select("ip", _us(), "monitor_id", "name")


@query("pool_5_monitor_values", """
SELECT ip, poll_us AS us, monitor, monitor_id, score, offset_s, round(rtt_s, 9) AS rtt_s FROM monitor_rows""")
def _(t: Inputs):
    values = pool.monitor_values(_parsed(t, "monitors"))
    return values.select("ip", _us(), "monitor", "monitor_id", "score", "offset_s", F.round("rtt_s", 9).alias("rtt_s"))


@query("pool_6_poll_outcome", """
SELECT p.ip, p.us, p.success, p.score, CASE WHEN p.success THEN n END AS monitors
FROM polls p LEFT JOIN (SELECT poll, count(*) AS n FROM monitor_rows GROUP BY poll) m ON m.poll = p.poll""")
def _(t: Inputs):
    polls = pool.poll_results(t.score_docs)
    return polls.select("ip", _us(), "success", "score", F.when(F.col("success"), F.size("values").cast("bigint")).alias("monitors"))


@query("snk_2_gauges", "SELECT ip, us, metric, monitor, round(value, 9) AS value FROM gauges")
def _(t: Inputs):
    gauges = pool.pool_gauges(pool.poll_results(t.score_docs))
    return gauges.select("ip", F.unix_micros("ts").alias("us"), "metric", "monitor", F.round("value", 9).alias("value"))


@query("win_8_retention", "SELECT ip, metric, monitor, tick, round(value, 9) AS value FROM retained")
def _(t: Inputs):
    gauges = pool.pool_gauges(pool.poll_results(t.score_docs))
    until = t.ticks.agg(F.max("tick")).scalar()
    held = retain(gauges, ["ip", "metric", "monitor"], FLUSH, until)
    return held.withColumn("value", F.round("value", 9))
