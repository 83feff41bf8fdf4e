"""Captured Ethernet frames to time-protocol packets, in native byte expressions.

Byte offsets are 0-based, as on the wire; only the SQL slices are 1-based.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.functions.binary import be_int, byte_slice, ip_text, low_nibble, once, plain_address

# Fixed wire values.
ETHERNET_BYTES = 14
TAG_BYTES = 4
IPV4_MIN_BYTES = 20
IPV6_BYTES = 40
UDP_BYTES = 8
PAYLOAD_BYTES = 48
ETHERTYPE_IPV4 = 0x0800
ETHERTYPE_IPV6 = 0x86DD
ETHERTYPE_TAGGED = 0x8100
PROTOCOL_UDP = 17
TIME_PORT = 123
FRAGMENT_MASK = 0x1FFF
REPLY_XID_AT = 24
REQUEST_XID_AT = 40

PACKET_COLUMNS = [
    "seq", "ts_ns", "ts", "direction", "client_ip", "client_bin", "src_ip", "dst_ip",
    "family", "version", "xid",
]


def _at(data: Column, offset, length: int) -> Column:
    return byte_slice(data, offset + 1, length)


def _int_at(data: Column, offset, length: int) -> Column:
    return be_int(data, offset + 1, length)


def _has(data: Column, size) -> Column:
    return F.octet_length(data) >= size


def decode_link(frames: DataFrame) -> DataFrame:
    """Add ``ethertype`` and ``l3_off``; both NULL where the frame is too short."""
    frame = F.col("frame")
    outer = once(frames, _outer=F.when(_has(frame, ETHERNET_BYTES), _int_at(frame, 12, 2)))
    tagged = F.col("_outer") == ETHERTYPE_TAGGED
    linked = once(
        outer,
        ethertype=F.when(~tagged, F.col("_outer")).when(
            tagged & _has(frame, ETHERNET_BYTES + TAG_BYTES), _int_at(frame, 16, 2)
        ),
    )
    offset = F.when(tagged, ETHERNET_BYTES + TAG_BYTES).otherwise(ETHERNET_BYTES)
    return once(linked, l3_off=F.when(F.col("ethertype").isNotNull(), offset)).drop("_outer")


def _network_layer(linked: DataFrame, versions: tuple[str, ...]) -> DataFrame:
    """Add family, raw addresses and the offset of the UDP header."""
    frame, off, kind = F.col("frame"), F.col("l3_off"), F.col("ethertype")
    linked = once(linked, _header=low_nibble(frame, off + 1) * 4)
    header = F.col("_header")
    v4 = (
        (kind == ETHERTYPE_IPV4)
        & _has(frame, off + IPV4_MIN_BYTES)
        & (header >= IPV4_MIN_BYTES)
        & _has(frame, off + header)
        & (_at(frame, off + 9, 1) == F.unhex(F.lit("11")))
    )
    v6 = (
        (kind == ETHERTYPE_IPV6)
        & _has(frame, off + IPV6_BYTES)
        & (_at(frame, off + 6, 1) == F.unhex(F.lit("11")))
    )
    family = F.lit(None).cast("string")
    if "ipv6" in versions:
        family = F.when(v6, "ipv6").otherwise(family)
    if "ipv4" in versions:
        family = F.when(v4, "ipv4").otherwise(family)
    out = once(linked, family=family)
    is4, is6 = F.col("family") == "ipv4", F.col("family") == "ipv6"
    return once(
        out,
        src_bin=F.when(is4, _at(frame, off + 12, 4)).when(is6, _at(frame, off + 8, 16)),
        dst_bin=F.when(is4, _at(frame, off + 16, 4)).when(is6, _at(frame, off + 24, 16)),
        l4_off=F.when(is4, (off + header).cast("int")).when(is6, (off + IPV6_BYTES).cast("int")),
    ).drop("_header")


def decode_ipv4(linked: DataFrame) -> DataFrame:
    return _network_layer(linked, ("ipv4",))


def decode_ipv6(linked: DataFrame) -> DataFrame:
    return _network_layer(linked, ("ipv6",))


def decode_network(linked: DataFrame) -> DataFrame:
    return _network_layer(linked, ("ipv4", "ipv6"))


def decode_direction(networked: DataFrame) -> DataFrame:
    """Add ``direction`` (NULL if not time traffic) and the client's address bytes.

    The destination port is looked at first, so a packet with the time port on
    both sides is a request.
    """
    frame, off = F.col("frame"), F.col("l4_off")
    whole = _has(frame, off + UDP_BYTES)
    port = F.unhex(F.lit(f"{TIME_PORT:04X}"))
    direction = F.when(whole & (_at(frame, off + 2, 2) == port), "request").when(
        whole & (_at(frame, off, 2) == port), "response"
    )
    out = once(networked, direction=direction)
    client = F.when(F.col("direction") == "request", F.col("src_bin")).when(
        F.col("direction") == "response", F.col("dst_bin")
    )
    out = once(out, _client=client)
    return once(out, client_bin=plain_address(F.col("_client"))).drop("_client")


def _payload_at() -> Column:
    return F.col("l4_off") + UDP_BYTES


def _whole_payload() -> Column:
    return F.col("direction").isNotNull() & _has(F.col("frame"), _payload_at() + PAYLOAD_BYTES)


def decode_version(directed: DataFrame) -> DataFrame:
    """Add ``version``: 1 to 4 as text, any other number as 'other'."""
    bits = F.shiftright(_int_at(F.col("frame"), _payload_at(), 1), 3).bitwiseAND(F.lit(7).cast("bigint"))
    numbered = once(directed, _number=F.when(_whole_payload(), bits))
    number = F.col("_number")
    name = F.when(number.between(1, 4), number.cast("string")).when(number.isNotNull(), "other")
    return once(numbered, version=name).drop("_number")


def decode_xid(directed: DataFrame) -> DataFrame:
    """Add the transaction id that links a response to its request."""
    frame, start = F.col("frame"), _payload_at()
    is_request = F.col("direction") == "request"
    place = start + F.when(is_request, REQUEST_XID_AT).otherwise(REPLY_XID_AT)
    return once(directed, xid=F.when(_whole_payload(), _at(frame, place, 8)))


def decode_addresses(directed: DataFrame) -> DataFrame:
    return (
        directed.withColumn("client_ip", ip_text(F.col("client_bin")))
        .withColumn("src_ip", ip_text(F.col("src_bin")))
        .withColumn("dst_ip", ip_text(F.col("dst_bin")))
    )


def decode_packets(frames: DataFrame) -> DataFrame:
    """All decoded columns but address text beside the frame; ``parsed`` tells valid packets."""
    out = decode_direction(decode_network(decode_link(frames)))
    return decode_xid(decode_version(out)).withColumn("parsed", F.col("direction").isNotNull())


def decode_frames(frames: DataFrame) -> DataFrame:
    """All decoded columns beside the frame."""
    return decode_addresses(decode_packets(frames))


def time_port_filter(frame: Column) -> Column:
    """The capture pre-filter as a boolean column, without tags or options of IPv6.

    It reads fixed places only and rejects when a place lies past the end, so it
    disagrees with the parser on tagged frames and on later IPv4 fragments.
    """
    port = F.unhex(F.lit(f"{TIME_PORT:04X}"))
    udp = F.unhex(F.lit("11"))
    kind = _int_at(frame, 12, 2)
    fragment = _int_at(frame, 20, 2).bitwiseAND(F.lit(FRAGMENT_MASK).cast("bigint"))
    v4_ports = ETHERNET_BYTES + low_nibble(frame, F.lit(15)) * 4
    v4 = (
        (_at(frame, 23, 1) == udp)
        & (fragment == 0)
        & ((_at(frame, v4_ports, 2) == port) | (_at(frame, v4_ports + 2, 2) == port))
    )
    v6 = (_at(frame, 20, 1) == udp) & ((_at(frame, 54, 2) == port) | (_at(frame, 56, 2) == port))
    keep = F.when(kind == ETHERTYPE_IPV4, v4).when(kind == ETHERTYPE_IPV6, v6)
    return F.coalesce(keep, F.lit(False))


def filter_frames(frames: DataFrame) -> DataFrame:
    return frames.where(time_port_filter(F.col("frame")))


def split_parsed(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packets that decode, and the captured frames that do not."""
    decoded = decode_packets(filter_frames(frames))
    packets = decode_addresses(decoded.where("parsed")).withColumn(
        "ts", F.timestamp_micros(F.call_function("div", F.col("ts_ns"), F.lit(1000).cast("bigint")))
    )
    return packets.select(*PACKET_COLUMNS), decoded.where("NOT parsed").select("seq", "ts_ns", "frame")


def keep_client_traffic(packets: DataFrame, local_ips: DataFrame) -> DataFrame:
    """Requests sent to, and responses sent from, an address that is ours at the time.

    One host per table: with frames of several hosts, join each host's own addresses.
    The server's own upstream polls and their replies drop out. All packets of a
    host share one local address, so beyond broadcast size the join relies on
    run-time splitting of the hot key (the packet side of a semi join splits).
    """
    ours = local_ips.select(
        F.col("ip").alias("_ip"), F.col("valid_from").alias("_from"), F.col("valid_to").alias("_to")
    )
    end = F.when(F.col("direction") == "request", F.col("dst_ip")).otherwise(F.col("src_ip"))
    tagged = packets.withColumn("_end", end)
    valid = (F.col("ts") >= F.col("_from")) & (F.col("_to").isNull() | (F.col("ts") < F.col("_to")))
    return tagged.join(ours, (F.col("_end") == F.col("_ip")) & valid, "left_semi").drop("_end")
