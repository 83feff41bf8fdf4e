"""Literal cases with the default parameters (FIXTURES.md, part D)."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from stratalens.functions.binary import ip_bin, ip_text
from stratalens.operators import alerts, clients, decode, enrich, latency, pool, probes, samples, traffic

S = 1_000_000_000
PACKET = "seq long, ts_ns long, direction string, client_ip string, xid binary"


def packets(spark, rows):
    """(seconds, direction, client, xid) rows as packets."""
    made = [(i, round(at * S), d, c, bytes([x]) * 8 if x is not None else None) for i, (at, d, c, x) in enumerate(rows)]
    return spark.createDataFrame(made, PACKET)


def drops(spark, rows):
    frame = spark.createDataFrame([(0, d, c) for d, c in rows], "ts_ns long, direction string, country string")
    return {r.country: r.drops for r in traffic.drops(frame.withColumn("continent", F.lit("x"))).collect()}


def test_drops(spark):
    assert drops(spark, [("request", "US")] * 3 + [("response", "US")]) == {"US": 2}
    assert drops(spark, [("request", "US")] + [("response", "US")] * 2 + [("response", "DE")]) == {}


def test_active_clients(spark):
    found = {r.tick: r.active for r in clients.active_clients(packets(spark, [(1000, "request", "a", 1)]), 300, 1).collect()}
    assert found[1300] == 1 and found.get(1301, 0) == 0 and found[1000] == 1


def test_intervals(spark):
    rows = clients.request_intervals(packets(spark, [(0, "request", "a", 1), (5, "request", "a", 2), (2, "request", "b", 1)])).collect()
    assert [(r.client_ip, r.seconds) for r in rows] == [("a", 5.0)]


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([(0, "request", "a", 1), (0.001, "response", "a", 1)], [0.001]),
        ([(0, "response", "a", 1)], []),
        ([(0, "request", "a", 1), (0.5, "response", "a", 2)], []),
        ([(0, "request", "a", 1), (1, "request", "a", 1), (1.25, "response", "a", 1)], [0.25]),
        ([(0, "request", "a", 1), (0.5, "response", "a", 1), (0.75, "response", "a", 1)], [0.5]),
        ([(0, "request", "a", 1), (2, "response", "a", 1)], [2.0]),
        ([(0, "request", "a", 1), (2.1, "response", "a", 1)], []),
        ([(0, "request", "a", 1), (0, "request", "b", 1), (1, "response", "b", 1)], [1.0]),
    ],
)
def test_pairing(spark, rows, want):
    assert [r.seconds for r in latency.pair_latency(packets(spark, rows)).collect()] == want


def frame(kind="ipv4", payload=48, vlan=False, words=5, ports=(40000, 123), first=0x23, protocol=17, cut=None, fragment=0, client="203.0.113.9"):
    server = {"ipv4": "198.51.100.1", "ipv6": "2001:db8:ffff::1"}[kind]
    src, dst = (ipaddress.ip_address(a).packed for a in (client, server))
    link = bytes(12) + (bytes.fromhex("8100000a") if vlan else b"")
    if kind == "ipv4":
        net = bytes([0x40 | words, 0, 0, 0, 0, 0]) + fragment.to_bytes(2, "big") + bytes([64, protocol, 0, 0]) + src + dst + bytes(4 * (words - 5))
        link += b"\x08\x00"
    else:
        net = b"\x60" + bytes(5) + bytes([protocol, 64]) + src + dst
        link += b"\x86\xdd"
    udp = ports[0].to_bytes(2, "big") + ports[1].to_bytes(2, "big") + bytes(4)
    body = bytes([first]) + bytes(23) + b"ORIGIN!!" + bytes(8) + b"TRANSMIT"
    data = link + net + udp + body[:payload]
    return data[:cut]


CASES = {
    "plain": (frame(), ("request", "203.0.113.9", "4", b"TRANSMIT")),
    "vlan": (frame(vlan=True), ("request", "203.0.113.9", "4", b"TRANSMIT")),
    "options": (frame(words=6), ("request", "203.0.113.9", "4", b"TRANSMIT")),
    "ipv6": (frame("ipv6", client="2001:db8::5"), ("request", "2001:db8::5", "4", b"TRANSMIT")),
    "extension header": (frame("ipv6", client="2001:db8::5", protocol=0), None),
    "other port": (frame(ports=(40000, 53)), None),
    "20 bytes": (frame(cut=20), None),
    "cut after the ports": (frame(cut=14 + 20 + 4), None),
    "short payload": (frame(payload=10), ("request", "203.0.113.9", None, None)),
    "version 7": (frame(first=0x3B), ("request", "203.0.113.9", "other", b"TRANSMIT")),
    "both ports": (frame(ports=(123, 123)), ("request", "203.0.113.9", "4", b"TRANSMIT")),
    "mapped": (frame("ipv6", client="::ffff:192.0.2.7"), ("request", "192.0.2.7", "4", b"TRANSMIT")),
    "empty": (b"", None),
}


def test_frames(spark):
    rows = [(i, 0, bytearray(data)) for i, (data, _) in enumerate(CASES.values())]
    decoded = decode.decode_frames(spark.createDataFrame(rows, "seq long, ts_ns long, frame binary"))
    for r, (name, (_, want)) in zip(decoded.orderBy("seq").collect(), CASES.items(), strict=True):
        got = (r.direction, r.client_ip, r.version, bytes(r.xid) if r.xid is not None else None) if r.parsed else None
        assert got == want, name


def test_port_filter(spark):
    rows = [frame(), frame(vlan=True), frame(fragment=0xB9), frame(ports=(1, 2)), frame("ipv6", client="::5"), frame(cut=20)]
    kept = decode.filter_frames(spark.createDataFrame([(i, 0, bytearray(f)) for i, f in enumerate(rows)], "seq long, ts_ns long, frame binary"))
    assert sorted(r.seq for r in kept.collect()) == [0, 4]


def test_decode_plan_is_small_and_compiles(spark):
    frames = spark.createDataFrame([(0, 0, bytearray(frame()))], "seq long, ts_ns long, frame binary")
    for part in decode.split_parsed(frames):
        assert len(part._jdf.queryExecution().optimizedPlan().toString()) < 60_000
    before = spark.conf.get("spark.sql.codegen.fallback")
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        assert decode.split_parsed(frames)[0].count() == 1
    finally:
        spark.conf.set("spark.sql.codegen.fallback", before)


def test_address_text(spark):
    rng = random.Random(1)
    addresses = [bytes(16), b"\0" * 15 + b"\1", b"\1" + b"\0" * 15, bytes.fromhex("20010db8000000010000000000000001")]
    for _ in range(200):
        addresses.append(b"".join(rng.choice([b"\0\0", b"\0\0", rng.randbytes(2), b"\0\1"]) for _ in range(8)))
    rows = spark.createDataFrame([(bytearray(a),) for a in addresses], "a binary").select(ip_text(F.col("a")).alias("t"), "a")
    for r in rows.collect():
        want = ipaddress.IPv6Address(bytes(r.a))
        assert r.t == str(want.ipv4_mapped or want)
    texts = spark.createDataFrame([("1.2.3.4",), ("::ffff:1.2.3.4",), ("1.2.3",), ("::1",), ("x",), (None,)], "t string")
    assert [r[0] and bytes(r[0]) for r in texts.select(ip_bin(F.col("t"))).collect()] == [
        b"\1\2\3\4", b"\1\2\3\4", None, bytes(15) + b"\1", None, None,
    ]


def test_asn_fold_in_text_order(spark):
    totals = spark.createDataFrame([(9, 5), (10, 5), (2, 1)], "asn long, total long")
    top = traffic.top_asn(totals, 1)
    assert [r.asn for r in top.collect()] == [10]
    counts = totals.selectExpr("0L AS flush", "asn", "concat('o', asn) AS as_org", "total AS requests")
    folded = {r.asn: r.requests for r in traffic.fold_asn(counts, top).groupBy("asn").agg(F.sum("requests").alias("requests")).collect()}
    assert folded == {"10": 5, "other": 6}


def sketch(spark, lo, hi, p=14, repeat=1):
    keys = spark.range(lo, hi).select(F.explode(F.array_repeat(F.concat(F.lit("10."), F.col("id").cast("string")), repeat)).alias("k"))
    return clients.hll_registers(keys, "k", p=p)


def estimate(registers):
    return clients.hll_estimate(registers).first().estimate


def test_sketches(spark):
    assert estimate(sketch(spark, 0, 0)) == 0
    for n in (1000, 100_000):
        assert abs(estimate(sketch(spark, 0, n)) - n) <= 0.03 * n
    assert estimate(sketch(spark, 0, 500, repeat=50)) == estimate(sketch(spark, 0, 500))
    both = clients.hll_merge(sketch(spark, 0, 3000).union(sketch(spark, 3000, 6000)))
    assert estimate(both) == estimate(sketch(spark, 0, 6000))


def test_mixed_precision_fails_whatever_is_read(spark):
    mixed = sketch(spark, 0, 100, 14).union(sketch(spark, 0, 100, 12))
    for plan in (clients.hll_merge(mixed).select("rho"), clients.hll_merge(mixed).select("idx", "rho"), clients.hll_estimate(mixed)):
        with pytest.raises(Exception, match="different precision"):
            plan.collect()


def test_unique_daily_expires(spark):
    rows = [(3 * 3600, "request", "a", 1), (7 * 3600, "request", "b", 1), (33 * 3600, "request", "c", 1)]
    found = {r.hour // 3600: round(r.unique_clients) for r in clients.unique_daily(packets(spark, rows)).collect()}
    assert found[7] == 2 and found[26] == 2 and found[27] == 1 and found[33] == 1


def test_percentiles(spark):
    rows = spark.createDataFrame([(v,) for v in (10, 2, 4, 1, 3)], "rtt_us long")
    assert tuple(probes.rtt_percentiles(rows).first()) == (3, 10, 10, 10)
    assert tuple(probes.rtt_percentiles(rows.limit(0)).first()) == (0, 0, 0, 0)


def docs(spark, *bodies):
    rows = [("a", i // 2, ("monitors", "overall")[i % 2], b) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "ip string, poll long, kind string, body string").withColumn("poll_ts", F.timestamp_seconds("poll"))


def test_score_documents(spark):
    mixed = '{"monitors":[{"id":1,"name":"m"}],"history":[{"ts":"2024-01-01","score":1,"monitor_id":1},{"ts":5,"score":2,"monitor_id":1,"rtt":13.5},{"ts":5,"score":3,"monitor_id":1}]}'
    parsed = pool.parse_docs(docs(spark, mixed, "{bad", '{"history":null}', '{"history":[{"score":"x"}]}'))
    rows = parsed.collect()
    assert [r.ok for r in rows] == [True, False, True, False]
    value = pool.monitor_values(parsed.where("ok")).first()
    assert (value.monitor, value.score, value.rtt_s) == ("m", 2.0, 0.0135)
    assert pool.overall_score(parsed.limit(1)).first().score == 2.0
    twins = '{"monitors":[{"id":1,"name":"m"},{"id":2,"name":"m"}],"history":[{"ts":1,"score":1,"monitor_id":1},{"ts":1,"score":2,"monitor_id":2}]}'
    assert [(r.monitor, r.monitor_id) for r in pool.monitor_values(pool.parse_docs(docs(spark, twins))).collect()] == [("m", 2)]


def test_poll_outcome(spark):
    good, null = '{"history":[{"ts":1,"score":7}]}', '{"history":[{"ts":1,"score":null}]}'
    polls = pool.poll_results(docs(spark, "{}", good, "{}", "{bad", "{}", null))
    assert [(r.success, r.score) for r in polls.orderBy("poll_ts").collect()] == [(True, 7.0), (False, None), (True, None)]


def test_counter_deltas(spark):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate((5, 9, 2, 4))], "at long, total long")
    found = samples.counter_delta(rows.select(F.timestamp_seconds("at").alias("ts"), "total")).orderBy("ts_us").collect()
    assert [r.delta for r in found] == [5, 4, 0, 2]
    series = rows.select(F.lit("m").alias("metric"), F.lit("").alias("series"), F.timestamp_seconds("at").alias("ts"), F.col("total").cast("double").alias("value"))
    assert samples.increase(series, 10, 3).where("tick = 3").first().increase == 8.0


def test_alert_states(spark):
    breaches = {0: True, 60: True, 120: True, 180: False, 240: True, 360: True, 420: True, 480: True, 540: None}
    rows = [("s", t, b) for t, b in breaches.items()]
    states = alerts.alert_state(spark.createDataFrame(rows, "series string, tick long, breach boolean"), 120).collect()
    assert {r.tick: r.state for r in states} == {
        0: "pending", 60: "pending", 120: "firing", 180: "normal", 240: "pending", 360: "pending", 420: "pending",
        480: "firing", 540: "nodata",
    }


def ranges(spark, *rows):
    made = [(bytearray(ipaddress.ip_address(a).packed), bytearray(ipaddress.ip_address(b).packed), c, "x") for a, b, c in rows]
    return spark.createDataFrame(made, "lo binary, hi binary, country string, continent string")


def test_range_lookup_of_both_families(spark):
    table = ranges(
        spark, ("1.0.0.0", "1.255.255.255", "one"), ("2.2.2.0", "2.2.2.127", "two"), ("2001:db8::", "2001:db8:0:ffff:ffff:ffff:ffff:ffff", "six"),
        ("2001:db8:1::", "2001:db8:1:ffff:ffff:ffff:ffff:ffff", ""),
    )
    asked = {"1.2.3.4": "one", "2.2.2.127": "two", "2.2.2.128": "unknown", "2001:db8::9": "six", "2001:db8:1::9": "unknown", "::1": "unknown"}
    rows = spark.createDataFrame([(a, bytearray(ipaddress.ip_address(a).packed)) for a in asked], "ip string, client_bin binary")
    plan = enrich.enrich_country(rows, table)
    assert {r.ip: r.country for r in plan.collect()} == asked
    assert "NestedLoop" not in plan._jdf.queryExecution().executedPlan().toString()


def test_wide_range_stays_small(spark):
    table = ranges(spark, ("::", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "all"))
    assert enrich.spread_ranges(table).count() <= 512
    rows = spark.createDataFrame([(bytearray(ipaddress.ip_address("2001:db8::1").packed),)], "client_bin binary")
    assert enrich.enrich_country(rows, table).first().country == "all"


def test_networks_as_ranges(spark, tmp_path):
    from stratalens.sources.readers import read_geo_country

    good = tmp_path / "good.csv"
    good.write_text("network,country,continent\n10.0.0.0/8,A,x\n192.0.2.128/25,B,x\n2001:db8::/33,C,x\n2001:db8:8000::/128,D,x\n")
    rows = {r.country: (str(ipaddress.ip_address(bytes(r.lo))), str(ipaddress.ip_address(bytes(r.hi)))) for r in read_geo_country(spark, str(good), networks=True).collect()}
    for text, name in (("10.0.0.0/8", "A"), ("192.0.2.128/25", "B"), ("2001:db8::/33", "C"), ("2001:db8:8000::/128", "D")):
        net = ipaddress.ip_network(text)
        assert rows[name] == (str(net[0]), str(net[-1]))
    bad = tmp_path / "bad.csv"
    bad.write_text("network,country,continent\n10.0.0/8,A,x\n")
    with pytest.raises(Exception, match="unreadable network"):
        read_geo_country(spark, str(bad), networks=True).collect()


def test_silent_networks_are_carried_while_they_may_rank(spark):
    rows = [(a, 0, 1000 - a) for a in range(1000)] + [(5000 + a, s, 10_000) for a in range(5) for s in range(1, 40)]
    carried = traffic.carried_totals(spark.createDataFrame(rows, "asn long, slice long, gain long"), 5)
    silent = carried.where("gain = 0").groupBy("slice").count().collect()
    assert all(r["count"] <= 1000 for r in silent if r.slice == 1) and not [r for r in silent if r.slice > 2]
    start = {(r.asn, r.slice): r.start for r in carried.where("gain > 0").collect()}
    assert start[5000, 3] == 20_000 and start[7, 0] == 0


def test_nested_networks(spark):
    """The narrowest network of an address counts; a packet comes back once; other overlaps fail."""
    from stratalens.functions.binary import ip_bin
    from stratalens.operators.enrich import cut_nested, enrich_country
    from stratalens.sources.readers import _network_bounds

    def ranges(*rows):
        return cut_nested(_network_bounds(spark.createDataFrame(rows, "network string, country string, continent string")))

    table = ranges(
        ("10.1.1.0/25", "DE", "EU"), ("10.1.1.0/26", "FR", "EU"), ("10.0.0.0/8", "US", "NA"), ("10.1.1.0/26", "FR", "EU"), ("0.0.0.0/0", "ZZ", ""),
        ("2001:db8::/32", "JP", "AS"), ("2001:db8:1::/48", "IN", "AS"),
    )
    want = {"10.1.1.5": "FR", "10.1.1.64": "DE", "10.1.1.127": "DE", "10.1.1.128": "US", "11.0.0.1": "ZZ", "255.255.255.255": "ZZ",
            "2001:db8:1::9": "IN", "2001:db8:2::9": "JP", "2001:db9::1": "unknown"}
    packets = spark.createDataFrame([(a,) for a in want], "client_ip string").withColumn("client_bin", ip_bin(F.col("client_ip")))
    found = enrich_country(packets, table).collect()
    assert len(found) == len(want) and {r.client_ip: r.country for r in found} == want
    pieces = sorted((bytes(r.lo), bytes(r.hi)) for r in table.collect() if len(r.lo) == 4)
    assert all(a[1] < b[0] for a, b in zip(pieces, pieces[1:]))
    one = spark.createDataFrame([(b"\x0a\x00\x00\x00", b"\x0a\x00\x00\x0f", "A"), (b"\x0a\x00\x00\x08", b"\x0a\x00\x00\x1f", "B")], "lo binary, hi binary, country string")
    for wrong in (lambda: cut_nested(one).collect(), lambda: ranges(("10.0.0.0/8", "A", ""), ("10.0.0.0/8", "B", "")).collect()):
        with pytest.raises(Exception, match="not nested|listed twice"):
            wrong()


def test_histogram_sum_beyond_bigint(spark):
    """Three values whose billionths together exceed a BIGINT."""
    frame = spark.createDataFrame([(5e9,), (4e9,), (3e9,)], "seconds double")
    found = {r.le: (r.cumulative, r.sum, r["count"]) for r in latency.histogram(frame, "seconds", [3e9, 4e9]).collect()}
    assert found == {"3000000000": (1, 12e9, 3), "4000000000": (2, 12e9, 3), "+Inf": (3, 12e9, 3)}
