"""Decoding, filters, lookup joins, counts and networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.operators import decode, enrich, traffic
from stratalens.operators.samples import geo_loaded
from stratalens.plans.inputs import FLUSH, TOP, Inputs
from stratalens.plans.registry import query

FLUSHES_PER_SLICE = 24


def _hex(*names: str):
    return [F.hex(n).alias(n.replace("_bin", "_hex")) for n in names]


@query("prj_1_link", """
SELECT seq, CASE WHEN family = 'ipv4' THEN 2048 ELSE 34525 END AS ethertype,
  CASE WHEN variant = 'tagged' THEN 18 ELSE 14 END AS l3_off FROM fr""")
def _(t: Inputs):
    return decode.decode_link(t.frames).select("seq", F.col("ethertype").cast("int").alias("ethertype"), "l3_off")


_NETWORK_SQL = """
SELECT seq, CASE WHEN ok THEN '{family}' END AS family, CASE WHEN ok THEN src_hex END AS src_hex,
  CASE WHEN ok THEN dst_hex END AS dst_hex,
  CASE WHEN ok THEN 14 + {header} + CASE WHEN variant IN ('tagged', 'options') THEN 4 ELSE 0 END END AS l4_off
FROM (SELECT *, family = '{family}' AND variant <> 'short' AS ok FROM fr)"""


@query("prj_2_ipv4", _NETWORK_SQL.format(family="ipv4", header=20))
def _(t: Inputs):
    return decode.decode_ipv4(decode.decode_link(t.frames)).select("seq", "family", *_hex("src_bin", "dst_bin"), "l4_off")


@query("prj_3_ipv6", _NETWORK_SQL.format(family="ipv6", header=40))
def _(t: Inputs):
    return decode.decode_ipv6(decode.decode_link(t.frames)).select("seq", "family", *_hex("src_bin", "dst_bin"), "l4_off")


def _directed(t: Inputs):
    return decode.decode_direction(decode.decode_network(decode.decode_link(t.frames)))


@query("prj_4_direction", "SELECT seq, dir AS direction, dec_client_hex AS client_hex FROM dec")
def _(t: Inputs):
    return _directed(t).select("seq", "direction", *_hex("client_bin"))


@query("prj_5_version", "SELECT seq, dec_version AS version FROM dec")
def _(t: Inputs):
    return decode.decode_version(_directed(t)).select("seq", "version")


@query("prj_6_xid", "SELECT seq, dec_xid AS xid FROM dec")
def _(t: Inputs):
    return decode.decode_xid(_directed(t)).select("seq", *_hex("xid"))


@query("prj_7_address_text", """
SELECT seq, dec_client_ip AS client_ip, CASE WHEN variant <> 'short' THEN src_ip END AS src_ip,
  CASE WHEN variant <> 'short' THEN dst_ip END AS dst_ip FROM dec""")
def _(t: Inputs):
    return decode.decode_addresses(_directed(t)).select("seq", "client_ip", "src_ip", "dst_ip")


@query("fil_1_time_port", "SELECT seq, captured FROM dec")
def _(t: Inputs):
    return t.frames.select("seq", decode.time_port_filter(F.col("frame")).alias("captured"))


@query("fil_2_parsed", """
SELECT seq, ts_ns, 'packet' AS kind, dir AS direction FROM dec WHERE captured AND parsed
UNION ALL SELECT seq, ts_ns, 'error', NULL FROM dec WHERE captured AND NOT parsed""")
def _(t: Inputs):
    packets, errors = decode.split_parsed(t.frames)
    return packets.select("seq", "ts_ns", F.lit("packet").alias("kind"), "direction").unionByName(
        errors.select("seq", "ts_ns", F.lit("error").alias("kind"), F.lit(None).cast("string").alias("direction"))
    )


@query("joi_1_client_traffic", """
SELECT seq, ts_ns, dir AS direction, dec_client_ip AS client_ip, family, dec_version AS version, dec_xid AS xid
FROM dec WHERE captured AND parsed
  AND CASE WHEN dir = 'request' THEN dst_ip ELSE src_ip END IN ('198.51.100.1', '2001:db8:ffff::1')""")
def _(t: Inputs):
    packets, _errors = decode.split_parsed(t.frames)
    kept = decode.keep_client_traffic(packets, t.local_ips)
    return kept.select("seq", "ts_ns", "direction", "client_ip", "family", "version", *_hex("xid"))


@query("joi_2_country", "SELECT seq, country, continent FROM pc")
def _(t: Inputs):
    return enrich.enrich_country(t.packets, t.geo_country).select("seq", "country", "continent")


@query("joi_3_asn", "SELECT seq, asn, as_org FROM pa")
def _(t: Inputs):
    return enrich.enrich_asn(t.packets, t.geo_asn).select("seq", "asn", "as_org")


@query("joi_4_versioned_lookup", """
SELECT p.seq, coalesce(g.country, 'unknown') AS country, coalesce(g.continent, 'unknown') AS continent
FROM (SELECT pk.seq, pk.num, v.version, v.readable FROM pk ASOF LEFT JOIN
        (SELECT * FROM timeline WHERE db = 'country') v ON pk.us >= v.valid_from * 1000000) p
LEFT JOIN (SELECT gc.lo + k.v * 134217728 AS lo, gc.hi + k.v * 134217728 AS hi, gc.country, gc.continent, k.v
           FROM gc CROSS JOIN (VALUES (0), (1), (2)) k(v)) g
  ON p.readable AND g.v = p.version AND p.num BETWEEN g.lo AND g.hi""")
def _(t: Inputs):
    timeline = enrich.table_timeline(t.geo_landings)
    until = t.timed.agg(F.max(F.unix_seconds("ts"))).scalar()
    found = enrich.enrich_country_versioned(t.packets, t.geo_country_versions, timeline, until)
    return found.select("seq", "country", "continent")


@query("joi_5_drops", "SELECT flush, country, continent, drops FROM drop_counts")
def _(t: Inputs):
    return traffic.drops(enrich.enrich_country(t.packets, t.geo_country), FLUSH)


@query("joi_6_fold_asn", """
SELECT flush, CASE WHEN c.asn IS NULL THEN 'unknown' WHEN k.asn IS NOT NULL THEN CAST(c.asn AS VARCHAR) ELSE 'other' END AS asn,
  CASE WHEN c.asn IS NULL THEN 'unknown' WHEN k.asn IS NOT NULL THEN c.as_org ELSE 'other' END AS as_org, requests
FROM asn_counts c LEFT JOIN (SELECT asn FROM asn_counts WHERE asn IS NOT NULL GROUP BY asn
  ORDER BY sum(requests) DESC, CAST(asn AS VARCHAR) LIMIT 10) k ON k.asn = c.asn""")
def _(t: Inputs):
    counts = traffic.requests_by_network(enrich.enrich_asn(t.packets, t.geo_asn), FLUSH)
    return traffic.fold_asn(counts, traffic.top_asn(_asn_totals(t), TOP))


@query("joi_8_seeded_labels", """
SELECT d.direction, coalesce(c.packets, 0) AS packets FROM (VALUES ('request'), ('response')) d(direction)
LEFT JOIN (SELECT direction, count(*) AS packets FROM pk GROUP BY 1) c ON c.direction = d.direction""")
def _(t: Inputs):
    counts = t.packets.groupBy("direction").agg(F.count("*").alias("packets"))
    return traffic.seed(counts, [], "direction", traffic.DIRECTIONS, "packets")


@query("agg_1_packets_by_direction", """
SELECT f.flush, d.direction, count(p.seq) AS packets
FROM (SELECT DISTINCT flush FROM pk) f CROSS JOIN (VALUES ('request'), ('response')) d(direction)
LEFT JOIN pk p ON p.flush = f.flush AND p.direction = d.direction GROUP BY ALL""")
def _(t: Inputs):
    return traffic.packets_by_direction(t.packets, FLUSH)


@query("agg_2_requests_by_country", """
SELECT flush, country, continent, count(*) AS requests FROM pc WHERE direction = 'request' GROUP BY ALL""")
def _(t: Inputs):
    return traffic.requests_by_country(enrich.enrich_country(t.packets, t.geo_country), FLUSH)


@query("agg_3_responses_by_country", """
SELECT flush, country, continent, count(*) AS responses FROM pc WHERE direction = 'response' GROUP BY ALL""")
def _(t: Inputs):
    return traffic.responses_by_country(enrich.enrich_country(t.packets, t.geo_country), FLUSH)


@query("agg_4_requests_by_asn", "SELECT flush, asn, as_org, requests FROM asn_folded")
def _(t: Inputs):
    return traffic.requests_by_asn(enrich.enrich_asn(t.packets, t.geo_asn), TOP, FLUSH, FLUSHES_PER_SLICE)


@query("agg_5_requests_by_version", """
SELECT flush, coalesce(version, 'other') AS version, count(*) AS requests FROM pk WHERE direction = 'request' GROUP BY ALL""")
def _(t: Inputs):
    return traffic.requests_by_version(t.packets, FLUSH)


@query("agg_6_requests_by_family", """
SELECT flush, family, count(*) AS requests FROM pk WHERE direction = 'request' GROUP BY ALL""")
def _(t: Inputs):
    return traffic.requests_by_family(t.packets, FLUSH)


@query("agg_7_parse_errors", """
SELECT flush, count(*) FILTER (NOT parsed) AS errors FROM dec WHERE captured GROUP BY ALL""")
def _(t: Inputs):
    return traffic.parse_errors(t.frames, FLUSH)


@query("agg_22_geo_loaded", """
SELECT t.tick, d.db, CASE WHEN v.readable THEN 1.0::DOUBLE ELSE 0.0 END AS value
FROM ticks t CROSS JOIN (VALUES ('country'), ('asn')) d(db)
ASOF LEFT JOIN timeline v ON v.db = d.db AND t.tick >= v.valid_from""")
def _(t: Inputs):
    until = t.ticks.agg(F.max("tick")).scalar()
    return geo_loaded(enrich.table_timeline(t.geo_landings), t.ticks, FLUSH, until)


@query("win_4_counters", """
SELECT flush, country, continent, requests,
  CAST(sum(requests) OVER (PARTITION BY country, continent ORDER BY flush) AS BIGINT) AS total
FROM (SELECT flush, country, continent, count(*) AS requests FROM pc WHERE direction = 'request' GROUP BY ALL)""")
def _(t: Inputs):
    increments = traffic.requests_by_country(enrich.enrich_country(t.packets, t.geo_country), FLUSH)
    return traffic.to_counter(increments, ["country", "continent"], "requests")


@query("win_5_top_asn_by_flush", "SELECT flush, asn, total, rank FROM asn_top")
def _(t: Inputs):
    counts = traffic.requests_by_network(enrich.enrich_asn(t.packets, t.geo_asn), FLUSH)
    return traffic.top_asn_by_flush(counts, TOP, FLUSH, FLUSHES_PER_SLICE)


def _asn_totals(t: Inputs):
    requests = t.packets.where(F.col("direction") == "request")
    return enrich.enrich_asn(requests, t.geo_asn).groupBy("asn").agg(F.count("*").alias("total"))


_TOP_SQL = """
SELECT asn, count(*) AS total FROM pa WHERE direction = 'request' AND asn IS NOT NULL GROUP BY asn
ORDER BY total DESC, CAST(asn AS VARCHAR) LIMIT {n}"""


@query("top_1_top_asn", _TOP_SQL.format(n=10))
def _(t: Inputs):
    return traffic.top_asn(_asn_totals(t), TOP)


@query("top_2_prune_totals", _TOP_SQL.format(n=50))
def _(t: Inputs):
    return traffic.prune_totals(_asn_totals(t), 50)
