"""Inputs written to the shared folder and read back by the readers, and the sample sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stratalens.operators import decode, enrich, traffic
from stratalens.operators.samples import family_samples, with_series
from stratalens.plans.inputs import FLUSH, Inputs
from stratalens.plans.registry import query
from stratalens.session import shared_path
from stratalens.sources import readers, sinks


def written(t: Inputs, df: DataFrame, label: str, fmt: str = "parquet") -> str:
    path = shared_path(t.spark, label)
    df.write.format(fmt).options(header="true", timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").save(path)
    return path


@query("src_1_frames", "SELECT seq, ts_ns, dir AS direction FROM dec")
def _(t: Inputs):
    frames = readers.read_frames(t.spark, written(t, t.frames, "frames"))
    return decode.decode_packets(frames).select("seq", "ts_ns", "direction")


@query("src_2_local_addresses", """
SELECT host, ip, min(us) AS from_us, CASE WHEN max(coalesce(next, 9223372036854775807)) < 9223372036854775807
  THEN max(next) END AS to_us FROM (
  SELECT *, sum(CASE WHEN prev_end IS NULL OR prev_end <> us THEN 1 ELSE 0 END) OVER (PARTITION BY host, ip ORDER BY us) AS span FROM (
    SELECT *, lag(next) OVER (PARTITION BY host, ip ORDER BY us) AS prev_end FROM (
      SELECT host, us, next, unnest(CASE WHEN three THEN ['198.51.100.1'] ELSE ['198.51.100.1', '2001:db8:ffff::1'] END) AS ip FROM (
        SELECT 'h' || CAST(user_id % 4 AS VARCHAR) AS host, us, user_id % 3 = 0 AS three,
          lead(us) OVER (PARTITION BY user_id % 4 ORDER BY us) AS next FROM ev WHERE event_id % 9 <> 4))))
GROUP BY host, ip, span""")
def _(t: Inputs):
    spans = readers.read_local_ips(t.spark, written(t, t.snapshots, "snapshots"))
    return spans.select("host", "ip", F.unix_micros("valid_from").alias("from_us"), F.unix_micros("valid_to").alias("to_us"))


@query("src_3_country_ranges", """
SELECT printf('%08X', lo) AS lo, printf('%08X', hi) AS hi, CASE WHEN country = 'unknown' THEN NULL ELSE country END AS country, continent FROM gc""")
def _(t: Inputs):
    ranges = readers.read_geo_country(t.spark, written(t, t.country_numbers, "country", "csv"))
    return ranges.select(F.hex("lo").alias("lo"), F.hex("hi").alias("hi"), F.nullif("country", F.lit("")).alias("country"), "continent")


@query("src_4_asn_ranges", "SELECT printf('%08X', lo) AS lo, printf('%08X', hi) AS hi, asn FROM ga")
def _(t: Inputs):
    ranges = readers.read_geo_asn(t.spark, written(t, t.asn_numbers, "asn", "csv"))
    return ranges.select(F.hex("lo").alias("lo"), F.hex("hi").alias("hi"), F.nullif("asn", F.lit(0).cast("bigint")).alias("asn"))


@query("src_5_score_documents", """
SELECT ip, us, 'monitors' AS kind FROM pd UNION ALL SELECT ip, us, 'overall' FROM pd WHERE has_overall""")
def _(t: Inputs):
    docs = readers.read_score_docs(t.spark, written(t, t.score_docs, "docs", "json"))
    return docs.where(F.length("body") > 2).select("ip", F.unix_micros("poll_ts").alias("us"), "kind")


@query("src_6_samples", "SELECT us, metric, 'chip_name=' || chip_name || ',country=' || country || ',host=edge-1' AS series, value FROM sm")
def _(t: Inputs):
    samples = with_series(readers.read_samples(t.spark, written(t, t.samples, "samples"), host="edge-1"))
    return samples.select(F.unix_micros("ts").alias("us"), "metric", "series", "value")


@query("src_7_logs", "SELECT us, container_name, host, msg FROM lg")
def _(t: Inputs):
    logs = readers.read_logs(t.spark, written(t, t.logs, "logs", "json"), "json")
    return logs.select(F.unix_micros("ts").alias("us"), "container_name", "host", "msg")


@query("src_8_probes", """
SELECT worker, cookie, sent_ns AS at_ns FROM sd UNION ALL SELECT worker, cookie, recv_ns FROM rp
UNION ALL SELECT worker, cookie, recv_ns + 7000000 FROM rp WHERE cookie % 10 = 1""")
def _(t: Inputs):
    sends, replies = readers.read_probes(t.spark, written(t, t.sends, "sends"), written(t, t.replies, "replies"))
    return sends.select("worker", "cookie", F.col("sent_ns").alias("at_ns")).union(replies.select("worker", "cookie", "recv_ns"))


@query("snk_1_write_samples", """
SELECT 'ntp_drops' AS metric, 'continent=' || continent || ',country=' || country AS series, flush AS tick, CAST(drops AS DOUBLE) AS value FROM drop_counts""")
def _(t: Inputs):
    drops = traffic.drops(enrich.enrich_country(t.packets, t.geo_country), FLUSH)
    path = shared_path(t.spark, "sink")
    sinks.write_samples(family_samples(drops, "ntp_drops", "drops", "flush", {"country": "country", "continent": "continent"}), path)
    return with_series(sinks.read_written(t.spark, path)).select("metric", "series", F.unix_seconds("ts").alias("tick"), "value")


@query("frames_to_drops", """
SELECT flush, country, continent, req - resp AS drops FROM (
  SELECT flush, coalesce(gc.country, 'unknown') AS country, coalesce(gc.continent, 'unknown') AS continent,
    count(*) FILTER (dir = 'request') AS req, count(*) FILTER (dir = 'response') AS resp
  FROM (SELECT *, CASE WHEN family = 'ipv4' THEN CAST('0x' || dec_client_hex AS BIGINT) END AS client_num FROM dec
        WHERE captured AND parsed AND CASE WHEN dir = 'request' THEN dst_ip ELSE src_ip END IN ('198.51.100.1', '2001:db8:ffff::1')) d
  LEFT JOIN gc ON d.client_num BETWEEN gc.lo AND gc.hi GROUP BY ALL) WHERE req > resp""")
def _(t: Inputs):
    """The whole way: captured frames, our clients' packets, their countries, unanswered requests per flush."""
    packets, _errors = decode.split_parsed(t.frames)
    ours = decode.keep_client_traffic(packets, t.local_ips)
    return traffic.drops(enrich.enrich_country(ours, t.geo_country), FLUSH)


@query("joi_2_nested_networks", """
SELECT seq, CASE WHEN n_nationkey = 7 THEN 'unknown' ELSE coalesce(n_name, 'unknown') END AS country, coalesce(r_name, 'unknown') AS continent
FROM (SELECT seq, CASE WHEN family = 'ipv6' THEN CASE WHEN host_no < 800 THEN host_no // 32 ELSE 0 END
    WHEN num // 134217728 < 25 THEN (num // 134217728 + CASE WHEN num % 134217728 BETWEEN 34603008 AND 34865151 THEN 2
      WHEN num % 134217728 BETWEEN 33554432 AND 50331647 THEN 1 ELSE 0 END) % 25 END AS key FROM pk)
LEFT JOIN nation ON n_nationkey = key LEFT JOIN region ON r_regionkey = n_regionkey""")
def _(t: Inputs):
    """Networks of both families, three deep, as a file lists them; the narrowest one counts."""
    nation = t.table("nation").join(t.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    named = nation.select(
        F.col("n_nationkey").cast("bigint").alias("key"), F.when(F.col("n_nationkey") == 7, "").otherwise(F.col("n_name")).alias("country"),
        F.col("r_name").alias("continent"),
    )

    def block(slot: int, offset: int, length: int):
        start = F.pmod(F.col("key") - slot, F.lit(25)) * 134217728 + offset
        octets = [F.shiftright(start, k).bitwiseAND(F.lit(255).cast("bigint")).cast("string") for k in (24, 16, 8, 0)]
        return F.concat(F.concat_ws(".", *octets), F.lit(f"/{length}"))

    inner6 = F.concat(F.lit("2001:db8::"), F.lower(F.hex(F.col("key") * 32)), F.lit("/123"))
    listed = F.array(block(0, 0, 5), block(1, 33554432, 8), block(2, 34603008, 14), inner6, F.when(F.col("key") == 0, "2001:db8::/64"))
    blocks = named.select(F.explode(F.array_compact(listed)).alias("network"), "country", "continent")
    networks = readers.read_geo_country(t.spark, written(t, blocks, "networks", "csv"), networks=True)
    return enrich.enrich_country(t.packets, networks).select("seq", "country", "continent")
