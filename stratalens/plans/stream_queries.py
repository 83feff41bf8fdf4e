"""Streams over the events, landed in files that come in several micro-batches and out of order, held against batch SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from stratalens.operators import enrich, streams
from stratalens.operators.decode import keep_client_traffic
from stratalens.operators.samples import with_series
from stratalens.operators.steps import AT, Step, closed, run_steps, written_steps
from stratalens.plans.client_queries import ESTIMATE, RAW
from stratalens.plans.inputs import ACTIVE_WINDOW, EVENTS_SCHEMA, FLUSH, TOP, TTL, Inputs, client_packets, frames, raw_packets, with_time
from stratalens.plans.registry import query
from stratalens.session import shared_path, written
from stratalens.sources import readers, sinks

PARTS = 4
JITTER_US = 3 * 3_600_000_000  # events come up to four times this late
LATE_S = 13 * 3600
HOUR_S = 3600


def landed(rows: DataFrame, part: Column, parts: int, label: str, fmt: str = "parquet") -> str:
    """A folder to which the rows come one part after the other, each a file, as a capture process leaves them."""
    path = shared_path(rows.sparkSession, label)
    for number in range(parts):
        rows.where(part == number).coalesce(1).write.mode("append").format(fmt).save(path)
    return path


def _event_part(t: Inputs) -> Column:
    """In which of PARTS parts an event comes: by time, some hours too late."""
    lo, hi = t.timed.agg(F.min("us"), F.max("us")).first()
    arrival = F.unix_micros(F.col("ts").cast("timestamp")) + F.col("event_id") % 5 * JITTER_US - lo
    return F.least(F.lit(PARTS - 1), F.floor(arrival * PARTS / (hi - lo + 1)))


def _run(t: Inputs, work: Callable[[Step], DataFrame], label: str, late: int = LATE_S, close: bool = False) -> DataFrame:
    """What the steps write over all events, a micro-batch a part; with close, also what then still waits.

    A part lands in as many files as tasks read the table, and the stream then takes up all of them: no task has a part to itself.
    """
    files, path, part = shared_path(t.spark, "events"), shared_path(t.spark, label), _event_part(t)
    time_ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    for number in range(PARTS):
        t.events.where(part == number).write.mode("append").parquet(files)
        source = t.spark.readStream.schema(EVENTS_SCHEMA).parquet(files)
        run_steps(source, path, time_ns, work, FLUSH, late).awaitTermination()
    if close:
        closed(source, path, time_ns, work, FLUSH)
    return written_steps(t.spark, path)


def _arrived(step: Step) -> DataFrame:
    """The step's events at the time at which they count."""
    return step.rows.withColumn("ts", F.timestamp_micros(F.floor(F.col(AT) / 1000)).cast("timestamp_ntz"))


@query("str_1_flush_counts", """
SELECT family, flush, l1, l2, n, CAST(sum(n) OVER (PARTITION BY family, l1, l2 ORDER BY flush) AS BIGINT) AS total FROM (
  SELECT 'packets' AS family, f.flush, d.direction AS l1, '' AS l2, count(p.seq) AS n
    FROM (SELECT DISTINCT flush FROM pk) f CROSS JOIN (VALUES ('request'), ('response')) d(direction)
    LEFT JOIN pk p ON p.flush = f.flush AND p.direction = d.direction GROUP BY ALL
  UNION ALL SELECT 'requests', flush, country, continent, count(*) FROM pc WHERE direction = 'request' GROUP BY ALL
  UNION ALL SELECT 'drops', flush, country, continent, drops FROM drop_counts
  UNION ALL SELECT 'networks', flush, asn, as_org, requests FROM asn_folded
  UNION ALL SELECT 'versions', flush, coalesce(version, 'other'), '', count(*) FROM pk WHERE direction = 'request' GROUP BY ALL
  UNION ALL SELECT 'families', flush, family, '', count(*) FROM pk WHERE direction = 'request' GROUP BY ALL
  UNION ALL SELECT 'errors', flush, '', '', count(*) FILTER (NOT parsed) FROM dec WHERE captured GROUP BY ALL)
WHERE flush < (SELECT until FROM closed)""")
def _(t: Inputs):
    """All counters of each flush in one pass, and their running totals."""
    countries, networks = t.geo_country.persist(), t.geo_asn.persist()

    def work(step: Step) -> DataFrame:
        events = _arrived(step)
        known = enrich.enrich_asn(enrich.enrich_country(client_packets(events), countries), networks)
        return streams.flush_families(step, known, frames(events), FLUSH, TOP)

    return _run(t, work, "flush")


@query("str_2_active_windows", "SELECT tick, active FROM active WHERE tick < (SELECT until FROM closed)")
def _(t: Inputs):
    return _run(t, lambda step: streams.active_step(step, client_packets(step.rows), ACTIVE_WINDOW, FLUSH), "active")


@query("str_3_hourly_sketches", f"""
SELECT hour, round({ESTIMATE}, 6) AS unique_clients FROM (SELECT hour, {RAW} FROM daily GROUP BY hour)""")
def _(t: Inputs):
    found = _run(t, lambda step: streams.hourly_step(step, client_packets(step.rows)), "sketch", close=True)
    return found.withColumn("unique_clients", F.round("unique_clients", 6))


@query("str_4_pairing", "SELECT seq, ts_ns, client_ip, xid, request_ns, seconds FROM pairs")
def _(t: Inputs):
    found = _run(t, lambda step: streams.pair_step(step, client_packets(streams.in_time(step)), TTL), "pairs", close=True)
    return found.withColumn("xid", F.hex("xid"))


@query("str_5_intervals", "SELECT seq, ts_ns, client_ip, seconds FROM gaps")
def _(t: Inputs):
    def work(step: Step) -> DataFrame:
        return streams.interval_step(step, client_packets(streams.in_time(step)), ACTIVE_WINDOW, FLUSH)

    return _run(t, work, "intervals", close=True)


@query("str_6_closed_windows", """
SELECT greatest(flush, coalesce(since, flush)) AS flush, family, count(*) AS packets, count(*) FILTER (flush < since) AS late
FROM pk JOIN arrival ON arrival.seq = pk.seq WHERE greatest(flush, coalesce(since, flush)) < last GROUP BY ALL""")
def _(t: Inputs):
    """Rows that come after their flush was closed count in the first flush still open, and as late."""

    def work(step: Step) -> DataFrame:
        step.rows = step.rows.where("event_id % 11 <> 0").withColumn("family", F.when(F.col("user_id") % 5 == 0, "ipv6").otherwise("ipv4"))
        return streams.late_counts(step, ["family"], FLUSH)

    return _run(t, work, "late", HOUR_S)


@query("str_7_score_polls", """
SELECT ip, us, success, score FROM polls WHERE poll IN (SELECT poll FROM pd WHERE has_overall OR
  us < (SELECT least(max(us), max(us) FILTER (has_overall)) FROM pd) // 1000 * 1000 - 691200000000)""")
def _(t: Inputs):
    """Every third overall document comes a file later than its poll's other one; some never come."""
    docs = t.score_docs.withColumn("us", F.unix_micros("poll_ts"))
    lo, hi = t.timed.agg(F.min("us"), F.max("us")).first()
    part = F.floor((F.col("us") - lo) * 5 / (hi - lo + 1))
    part = F.least(F.lit(4), part + F.when((F.col("kind") == "overall") & (F.col("us") % 3 == 0), 1).otherwise(0))
    text = F.date_format("poll_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    docs = written(docs.withColumn("part", part.cast("int")).withColumn("poll_ts", text).drop("us"), "polled")
    files, path = shared_path(t.spark, "docs"), shared_path(t.spark, "polls")
    for number in range(5):
        docs.where(F.col("part") == number).drop("part").write.mode("append").json(files)
        source = readers.read_score_docs(t.spark, files, streaming=True)
        polls = streams.drain(streams.poll_stream(source, "8 days"), path, each=streams.poll_outcomes)
    return polls.select("ip", F.unix_micros("poll_ts").alias("us"), "success", "score")


@query("str_8_log_volume", """
SELECT (us // 3600000000) * 3600 AS flush, container_name, count(*) AS count FROM lg GROUP BY ALL""")
def _(t: Inputs):
    logs = with_time(t.event_stream()).select("ts", F.concat(F.lit("/c-"), F.col("event_type")).alias("container_name"))
    counts = streams.windowed_counts(logs, ["container_name"], FLUSH, "10 seconds", "count")
    return streams.latest(streams.drain(counts, shared_path(t.spark, "logs"), "update"), ["flush", "container_name"], "count")


@query("str_9_enriched", """
SELECT p.seq, coalesce(g.country, 'unknown') AS country, coalesce(g.continent, 'unknown') AS continent, p.asn
FROM (SELECT pa.seq, pa.num, pa.asn, v.version, v.readable FROM pa ASOF LEFT JOIN
        (SELECT * FROM timeline WHERE db = 'country') v ON pa.us >= v.valid_from * 1000000
      WHERE pa.us < (SELECT until FROM closed) * 1000000) p
LEFT JOIN (SELECT gc.lo + k.v * 134217728 AS lo, gc.hi + k.v * 134217728 AS hi, gc.country, gc.continent, k.v
           FROM gc CROSS JOIN (VALUES (0), (1), (2)) k(v)) g
  ON p.readable AND g.v = p.version AND p.num BETWEEN g.lo AND g.hi""")
def _(t: Inputs):
    """Every micro-batch reads the tables anew: own addresses, and the versions of the country table that have come so far."""

    def work(step: Step) -> DataFrame:
        now, until = Inputs(t.spark, t.dir), F.lit(step.until).cast("long")
        kept = keep_client_traffic(raw_packets(step.rows), now.local_ips)
        timeline = enrich.table_timeline(now.geo_landings.where(F.col("seen_at") < until))
        found = enrich.enrich_country_versioned(enrich.enrich_asn(kept, now.geo_asn), now.geo_country_versions, timeline, until)
        return found.select("seq", "country", "continent", "asn")

    return _run(t, work, "enriched")


@query("snk_1_stream_samples", "SELECT us, metric, series, value FROM sms")
def _(t: Inputs):
    """Samples that come in files, written by the streaming sink, whose folders are merged on the way."""
    files = landed(t.samples, F.pmod(F.unix_micros("ts"), F.lit(7)), 7, "scraped")
    source = readers.read_samples(t.spark, files, streaming=True, maxFilesPerTrigger=1)
    path = shared_path(t.spark, "streamed")
    sinks.stream_samples(source, path, shared_path(t.spark, "sink_state"), merge_every=3).awaitTermination()
    samples = with_series(sinks.read_streamed(t.spark, path))
    return samples.select(F.unix_micros("ts").alias("us"), "metric", "series", "value")
