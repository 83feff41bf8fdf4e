"""The engine's inputs, derived from the driver's tables (see FIXTURES.md).

Everything is a lazy plan over ``events``, ``nation``, ``region`` and
``supplier``; the SQL side in ``sqlbase`` derives the same rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.functions.binary import once
from stratalens.functions.slices import running_sum
from stratalens.operators.enrich import ipv4_ranges
from stratalens.operators.samples import tick_grid
from stratalens.session import pin_utc

SERVER_V4, SERVER_V4_HEX = "198.51.100.1", "C6336401"
SERVER_V6, SERVER_V6_HEX = "2001:db8:ffff::1", "20010DB8FFFF00000000000000000001"
EVENTS_SCHEMA = (
    "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
)
FLUSH = 3600
ACTIVE_WINDOW = 86_400
TTL = 43_200
TOP = 10
DOC_EVENTS = 16


def with_time(events: DataFrame) -> DataFrame:
    """Zone-less event times read as UTC, plus epoch microseconds."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("us", F.unix_micros("ts"))


def _v6_text() -> Column:
    n = F.col("user_id") + 1
    low = F.lower(F.hex(F.pmod(n, F.lit(65536).cast("bigint"))))
    high = F.lower(F.hex(F.shiftright(n, 16)))
    return F.concat(F.lit("2001:db8::"), F.when(n < 65536, low).otherwise(F.concat(high, F.lit(":"), low)))


def raw_packets(events: DataFrame) -> DataFrame:
    """All packets, upstream ones included, as the server's traffic looks to it."""
    v6 = F.col("user_id") % 5 == 0
    num = F.pmod(F.col("user_id") * F.lit(2654435761), F.lit(4294967296))
    octet = lambda shift: F.shiftright(num, shift).bitwiseAND(F.lit(255).cast("bigint")).cast("string")
    k = F.col("event_id") % 7
    base = with_time(events).select(
        F.col("event_id").alias("seq"),
        (F.col("us") * 1000).alias("ts_ns"),
        "ts",
        F.when(F.col("event_type").isin("click", "view", "signup"), "request").otherwise("response").alias("direction"),
        F.when(v6, _v6_text()).otherwise(F.concat_ws(".", *[octet(s) for s in (24, 16, 8, 0)])).alias("client_ip"),
        F.when(v6, F.concat(F.lit("20010DB8"), F.lpad(F.hex(F.col("user_id") + 1), 24, "0")))
        .otherwise(F.lpad(F.hex(num), 8, "0"))
        .alias("client_hex"),
        F.when(v6, "ipv6").otherwise("ipv4").alias("family"),
        F.when(k == 0, None).when(k <= 4, k.cast("string")).otherwise("other").alias("version"),
        F.when(k != 0, F.unhex(F.lpad(F.hex(F.col("event_id") % 2), 16, "0"))).alias("xid"),
        (F.col("event_id") % 11 != 0).alias("is_client"),
        k.alias("version_number"),
    )
    server = F.when(F.col("family") == "ipv6", SERVER_V6).otherwise(SERVER_V4)
    from_client = F.col("is_client") == (F.col("direction") == "request")
    return (
        base.withColumn("client_bin", F.unhex("client_hex"))
        .withColumn("src_ip", F.when(from_client, F.col("client_ip")).otherwise(server))
        .withColumn("dst_ip", F.when(from_client, server).otherwise(F.col("client_ip")))
    )


def client_packets(events: DataFrame) -> DataFrame:
    """Packets as they are after decoding and the direction filter."""
    return raw_packets(events).where("is_client").select(
        "seq", "ts_ns", "ts", "direction", "client_ip", "client_bin", "src_ip", "dst_ip", "family", "version", "xid"
    )


def frame_variant() -> Column:
    """Which irregularity, if any, the frame of an event gets."""
    n = F.col("seq")
    v4 = F.col("family") == "ipv4"
    return (
        F.when(n % 23 == 5, "cut")
        .when(n % 29 == 7, "tagged")
        .when(n % 31 == 3, "other_port")
        .when((n % 37 == 11) & v4, "fragment")
        .when(n % 41 == 2, "short")
        .when((n % 43 == 9) & v4, "options")
        .when(n % 47 == 4, "both_ports")
        .otherwise("plain")
    )


def frames(events: DataFrame) -> DataFrame:
    """The packets as Ethernet frames, byte for byte, with some irregular ones."""
    p = raw_packets(events).withColumn("variant", frame_variant())
    v6 = F.col("family") == "ipv6"
    is_variant = lambda name: F.col("variant") == name
    server = F.when(v6, SERVER_V6_HEX).otherwise(SERVER_V4_HEX)
    from_client = F.col("is_client") == (F.col("direction") == "request")
    src = F.when(from_client, F.col("client_hex")).otherwise(server)
    dst = F.when(from_client, server).otherwise(F.col("client_hex"))
    link = F.concat(
        F.lit("02000000000A02000000000B"),
        F.when(is_variant("tagged"), "8100000A").otherwise(""),
        F.when(v6, "86DD").otherwise("0800"),
    )
    v4_header = F.concat(
        F.when(is_variant("options"), "46").otherwise("45"),
        F.lit("0000000000"),
        F.when(is_variant("fragment"), "00B9").otherwise("0000"),
        F.lit("40110000"),
        src, dst,
        F.when(is_variant("options"), "01010101").otherwise(""),
    )
    network = F.when(v6, F.concat(F.lit("6000000000001140"), src, dst)).otherwise(v4_header)
    time_port, port, other = F.lit("007B"), F.lit("9C40"), F.lit("0035")
    request = F.col("direction") == "request"
    ports = (
        F.when(is_variant("other_port"), F.concat(port, other))
        .when(is_variant("both_ports"), F.concat(time_port, time_port))
        .when(request, F.concat(port, time_port))
        .otherwise(F.concat(time_port, port))
    )
    first = F.lpad(F.hex(F.col("version_number") * 8 + 3), 2, "0")
    xid, zeros = F.hex("xid"), F.repeat(F.lit("0"), 16)
    payload = F.when(F.col("xid").isNull(), F.repeat(F.lit("0"), 20)).otherwise(
        F.concat(
            first, F.repeat(F.lit("0"), 46),
            F.when(request, zeros).otherwise(xid),
            zeros,
            F.when(request, xid).otherwise(F.repeat(F.lit("F"), 16)),
        )
    )
    udp = F.concat(ports, F.when(is_variant("cut"), "").otherwise(F.concat(F.lit("00380000"), payload)))
    digits = F.concat(link, network, udp)
    data = F.unhex(F.when(is_variant("short"), F.substring(digits, 1, 40)).otherwise(digits))
    return once(p.select("seq", "ts_ns", data.alias("_data")), frame=F.col("_data")).drop("_data")


class Inputs:
    """All inputs for one table folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = pin_utc(spark)
        self.dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events")

    def event_stream(self) -> DataFrame:
        return (
            self.spark.readStream.schema(EVENTS_SCHEMA)
            .option("pathGlobFilter", "events.parquet")
            .parquet(self.dir)
        )

    @cached_property
    def timed(self) -> DataFrame:
        return with_time(self.events)

    @cached_property
    def packets(self) -> DataFrame:
        return client_packets(self.events)

    @cached_property
    def frames(self) -> DataFrame:
        return frames(self.events)

    @cached_property
    def local_ips(self) -> DataFrame:
        """The server's addresses, from the first event on."""
        start = self.timed.agg(F.min("ts").alias("valid_from"))
        return start.select(
            F.explode(F.array(F.lit(SERVER_V4), F.lit(SERVER_V6))).alias("ip"),
            "valid_from",
            F.lit(None).cast("timestamp").alias("valid_to"),
        )

    @cached_property
    def country_numbers(self) -> DataFrame:
        nation, region = self.table("nation"), self.table("region")
        lo = F.col("n_nationkey").cast("bigint") * 134217728
        return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
            lo.alias("lo"), (lo + 134217727).alias("hi"),
            F.when(F.col("n_nationkey") == 7, "").otherwise(F.col("n_name")).alias("country"),
            F.col("r_name").alias("continent"),
        )

    @cached_property
    def asn_numbers(self) -> DataFrame:
        supplier = self.table("supplier")
        width = F.floor(F.lit(4294967296.0) / (supplier.agg(F.count("*")).scalar() * F.lit(1.25))).cast("bigint")
        key = F.col("s_suppkey").cast("bigint")
        return supplier.withColumn("_w", width).select(
            (key * F.col("_w")).alias("lo"), (key * F.col("_w") + F.col("_w") - 1).alias("hi"),
            F.when(key % 17 == 3, 0).otherwise(key + 64500).cast("bigint").alias("asn"),
            F.when(key % 13 == 5, "").otherwise(F.col("s_name")).alias("as_org"),
        )

    @cached_property
    def geo_country(self) -> DataFrame:
        return ipv4_ranges(self.country_numbers)

    @cached_property
    def geo_asn(self) -> DataFrame:
        return ipv4_ranges(self.asn_numbers)

    @cached_property
    def geo_landings(self) -> DataFrame:
        """One look at each lookup file per day with events."""
        day = F.call_function("div", F.col("us"), F.lit(86_400_000_000).cast("bigint"))
        days = self.timed.groupBy(day.alias("day")).agg(F.min("us").alias("us"))
        seen = F.call_function("div", F.col("us"), F.lit(1_000_000).cast("bigint"))
        return days.select(
            F.explode(F.array(F.lit("country"), F.lit("asn"))).alias("db"), "day", seen.alias("seen_at")
        ).select(
            "db", "seen_at",
            F.pmod(F.col("day"), F.lit(3)).cast("int").alias("version"),
            F.when(F.col("db") == "country", F.col("day") % 5 != 0).otherwise(F.col("day") % 4 != 1).alias("readable"),
            (F.col("day") % 7 != 3).alias("present"),
        )

    @cached_property
    def geo_country_versions(self) -> DataFrame:
        """Three versions of the country table; each shifts the ranges by one slot."""
        v = self.country_numbers.withColumn("version", F.explode(F.sequence(F.lit(0), F.lit(2))))
        shift = F.col("version") * F.lit(134217728).cast("bigint")
        return ipv4_ranges(v.withColumn("lo", F.col("lo") + shift).withColumn("hi", F.col("hi") + shift))

    @cached_property
    def score_docs(self) -> DataFrame:
        """One poll per 16 events: a document per monitor view and an overall one."""
        poll = F.call_function("div", F.col("event_id"), F.lit(DOC_EVENTS).cast("bigint"))
        coarse = F.call_function("div", F.col("us"), F.lit(300_000_000).cast("bigint")) * 300
        number = F.format_string("%d", coarse)
        text = F.concat(F.lit('"'), F.date_format(F.timestamp_seconds(coarse), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"'))
        ts = F.when(F.col("event_id") % 17 == 0, text).otherwise(number)
        shown = lambda c: c.cast("decimal(18,2)").cast("string")
        score = F.when(F.col("event_id") % 19 == 0, "null").otherwise(shown(F.col("value")))
        monitor = F.when(F.col("event_id") % 13 == 0, "null").otherwise((F.col("user_id") % 7).cast("string"))
        entry = F.concat(
            F.lit('{"ts":'), ts, F.lit(',"score":'), score, F.lit(',"offset":'), shown(F.col("value")),
            F.lit(',"rtt":'), shown(F.col("value")), F.lit(',"monitor_id":'), monitor, F.lit(',"step":1}'),
        )
        overall = F.concat(
            F.lit('{"ts":'), ts, F.lit(',"score":'), score, F.lit(',"monitor_id":null}')
        )
        docs = (
            self.timed.withColumn("poll", poll)
            .groupBy("poll")
            .agg(
                F.max("us").alias("us"),
                F.sort_array(F.collect_list(F.struct("event_id", entry.alias("m"), overall.alias("o")))).alias("e"),
            )
        )
        listed = ",".join([f'{{"id":{i},"name":"mon-{i}","type":"monitor"}}' for i in range(5)] + ['{"id":5,"name":""}'])
        array = lambda field: F.array_join(F.transform("e", lambda e: e[field]), ",")
        whole = F.concat(F.lit(f'{{"monitors":[{listed}],"history":['), array("m"), F.lit("]}"))
        single = F.concat(F.lit('{"history":['), array("o"), F.lit("]}"))
        broken = (
            F.when(F.col("poll") % 29 == 0, F.substring(whole, F.lit(1), F.length(whole) - 3))
            .when(F.col("poll") % 31 == 0, F.regexp_replace(whole, '"offset":', '"offset":true,"x":'))
            .otherwise(whole)
        )
        both = F.array(
            F.struct(F.lit("monitors").alias("kind"), broken.alias("body")),
            F.struct(F.lit("overall").alias("kind"), single.alias("body")),
        )
        return docs.select(
            F.timestamp_micros("us").alias("poll_ts"),
            F.concat(F.lit("198.51.100."), (F.col("poll") % 3).cast("string")).alias("ip"),
            F.inline(F.when(F.col("poll") % 37 == 5, F.slice(both, 1, 1)).otherwise(both)),
        )

    @cached_property
    def samples(self) -> DataFrame:
        """Every event as one sample named after its type."""
        return self.timed.select(
            F.col("event_type").alias("metric"),
            F.create_map(
                F.lit("host"), F.concat(F.lit("h"), (F.col("user_id") % 4).cast("string")),
                F.lit("chip_name"), F.when(F.col("user_id") % 3 == 0, "cpu_thermal").when(F.col("user_id") % 3 == 1, "nvme").otherwise("wifi"),
                F.lit("country"), F.concat(F.lit("c"), (F.col("user_id") % 9).cast("string")),
            ).alias("labels"),
            "ts",
            "value",
        )

    @cached_property
    def counters(self) -> DataFrame:
        """A counter per event type and host: cents of the value summed up per day."""
        day = F.call_function("div", F.col("us"), F.lit(86_400_000_000).cast("bigint"))
        host = F.concat(F.lit("h"), (F.col("user_id") % 4).cast("string"))
        rows = self.timed.select(
            "event_id", "us", "ts", "event_type", host.alias("host"), day.alias("day"),
            F.round(F.col("value") * 100).cast("bigint").alias("cents"),
        )
        summed = running_sum(rows, ["event_type", "host", "day"], "us", ["event_id"], "cents", "total", 21_600_000_000)
        return summed.select(
            F.col("event_type").alias("metric"),
            F.create_map(F.lit("host"), F.col("host")).alias("labels"),
            "ts",
            F.col("total").cast("double").alias("value"),
        )

    @cached_property
    def alert_samples(self) -> DataFrame:
        """Each event as a sample of the metrics the alert rules read."""
        host = F.concat(F.lit("h"), (F.col("user_id") % 3).cast("string"))
        v, kind = F.col("value"), F.col("event_type")
        low = lambda cut: F.when(v < cut, 0.0).otherwise(1.0)
        host_map = F.create_map(F.lit("host"), host)
        db_map = F.create_map(F.lit("db"), F.when(F.col("user_id") % 2 == 0, "country").otherwise("asn"))
        sample = lambda metric, labels, value: F.struct(
            F.lit(metric).alias("metric"), labels.alias("labels"), value.cast("double").alias("value")
        )
        wanted = (
            F.when(kind == "click", F.array(sample("chrony_up", host_map, low(70)), sample("ntp_clients_scrape_success", F.create_map(F.lit("job"), F.lit("ntp-clients")), low(80))))
            .when(kind == "view", F.array(sample("chrony_tracking_system_time_seconds", host_map, (F.lit(12.0) - v) / 1000), sample("ntppool_score", F.create_map(F.lit("ip"), host), F.lit(20.0) - v / 5)))
            .when(kind == "purchase", F.array(sample("chrony_sources_reachability_ratio", host_map, low(95))))
            .when(kind == "signup", F.array(sample("ntp_geoip_database_loaded", db_map, low(60))))
        )
        return self.timed.where(wanted.isNotNull()).select("ts", F.inline(wanted)).select("metric", "labels", "ts", "value")

    @cached_property
    def alert_counters(self) -> DataFrame:
        """Counters watched by alerts: large values of an event type move them."""
        names = F.when(F.col("metric") == "error", "ntp_capture_kernel_drops_total").when(
            F.col("metric") == "click", "chrony_serverstats_ntp_packets_received_total"
        ).when(F.col("metric") == "view", "chrony_serverstats_ntp_packets_dropped_total").when(
            F.col("metric") == "signup", "chrony_serverstats_client_log_records_dropped_total"
        ).otherwise("node_boot_total")
        return self.counters.withColumn("metric", names)

    @cached_property
    def ticks(self) -> DataFrame:
        return tick_grid(self.timed, F.col("us"), FLUSH)

    @cached_property
    def drop_readings(self) -> DataFrame:
        """Running count of error events per day, one reading per error."""
        day = F.call_function("div", F.col("us"), F.lit(86_400_000_000).cast("bigint"))
        errors = self.timed.where(F.col("event_type") == "error").select("event_id", "us", "ts", day.alias("day"))
        return running_sum(errors, ["day"], "us", ["event_id"], F.lit(1), "total", 21_600_000_000).select("ts", "total")

    @cached_property
    def logs(self) -> DataFrame:
        return self.timed.select(
            "ts",
            F.lit("containers").alias("job"),
            F.lit("time-stack").alias("compose_project"),
            F.concat(F.lit("/c-"), F.col("event_type")).alias("container_name"),
            F.concat(F.lit("h"), (F.col("user_id") % 4).cast("string")).alias("host"),
            F.col("props").alias("msg"),
        )

    @cached_property
    def sends(self) -> DataFrame:
        return self.timed.select(
            (F.col("user_id") % 8).cast("int").alias("worker"),
            F.col("event_id").alias("cookie"),
            (F.col("us") * 1000).alias("sent_ns"),
        )

    @cached_property
    def replies(self) -> DataFrame:
        """A reply unless the id is a multiple of 50; some come twice."""
        first = F.col("us") * 1000 + F.round(F.col("value") * 1000).cast("bigint") * 1000
        times = F.when(F.col("event_id") % 10 == 1, F.array(first, first + 7_000_000)).otherwise(F.array(first))
        return self.timed.where(F.col("event_id") % 50 != 0).select(
            (F.col("user_id") % 8).cast("int").alias("worker"),
            F.col("event_id").alias("cookie"),
            F.explode(times).alias("recv_ns"),
        )

    @cached_property
    def snapshots(self) -> DataFrame:
        """An address snapshot per event, some of them failed."""
        return self.timed.select(
            F.concat(F.lit("h"), (F.col("user_id") % 4).cast("string")).alias("host"),
            F.col("ts").alias("loaded_at"),
            (F.col("event_id") % 9 != 4).alias("ok"),
            F.when(F.col("user_id") % 3 == 0, F.array(F.lit(SERVER_V4)))
            .otherwise(F.array(F.lit(SERVER_V4), F.lit(SERVER_V6)))
            .alias("ips"),
        )
