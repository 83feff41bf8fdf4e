"""Country and network lookup by address range.

A range condition alone plans as a nested loop over the table. Every range is therefore filed under one or two address
prefixes, of the finest of four lengths at which its ends lie in the same or in neighbouring prefixes, and packets are
joined on the prefix, length by length, with the range test on top. However wide a range is, it makes two rows at
most, so Spark's estimate of the table's size holds and a narrow range shares its prefix with its neighbours only.
Ranges of one table must be disjoint, so a packet meets at most one of them and the left joins keep the row count; the
readers cut nested networks into disjoint pieces (``cut_nested``).

No side is hinted: Spark broadcasts a length's ranges while they are under the session's threshold, and beyond that
sorts and merges on the prefix, where a hot prefix of the packet side is split at run time.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalens.functions.binary import BUCKET_LEVELS, address_bucket, once
from stratalens.functions.timegrid import SECOND_NS, ceil_to, grid_index

UNKNOWN = "unknown"
RELOAD_CHECK_S = 30
DAY_S = 86_400


def ipv4_ranges(table: DataFrame) -> DataFrame:
    """Turn BIGINT bounds of an IPv4 table into the BINARY bounds joined on."""
    as_bytes = lambda name: F.unhex(F.lpad(F.hex(F.col(name)), 8, "0"))
    return table.withColumn("lo", as_bytes("lo")).withColumn("hi", as_bytes("hi"))


def _innermost(group: pa.Table) -> pa.Table:
    """Disjoint pieces of the ranges that meet one bucket of addresses, each with the narrowest range there.

    A sweep by first address keeps the open ranges on a stack, the innermost on top.
    """
    if not group.num_rows:
        return group.drop_columns(["_cell"])
    whole = [(int.from_bytes(a), int.from_bytes(b)) for a, b in zip(group["lo"].to_pylist(), group["hi"].to_pylist(), strict=True)]
    size = len(group["lo"][0].as_py())
    below = 8 * (size - CELL_BYTES[size])
    low = group["_cell"][0].as_py() << below
    high = low + (1 << below) - 1
    names = [c for c in group.column_names if c not in ("lo", "hi", "_cell")]
    pieces: list[tuple[int, int, int]] = []
    open_: list[int] = []
    at = low

    def cover(row: int, end: int) -> None:
        nonlocal at
        if at <= end:
            pieces.append((row, at, end))
            at = end + 1

    for row in sorted(range(len(whole)), key=lambda i: (whole[i][0], -whole[i][1])):
        first, last = whole[row]
        while open_ and whole[open_[-1]][1] < first:
            cover(open_[-1], min(whole[open_[-1]][1], high))
            open_.pop()
        if open_ and last > whole[open_[-1]][1]:
            raise ValueError(f"networks overlap but are not nested: {whole[open_[-1]]} and {whole[row]}")
        if open_ and whole[open_[-1]] == (first, last):
            if any(group[c][row] != group[c][open_[-1]] for c in names):
                raise ValueError(f"one network is listed twice with different values: {whole[row]}")
            continue
        if open_:
            cover(open_[-1], max(first, low) - 1)
        at = max(at, first)
        open_.append(row)
    while open_:
        cover(open_[-1], min(whole[open_[-1]][1], high))
        open_.pop()
    out = group.select(names).take(pa.array([r for r, _, _ in pieces], pa.int64()))
    for name, values in (("lo", [a for _, a, _ in pieces]), ("hi", [b for _, _, b in pieces])):
        out = out.append_column(name, pa.array([v.to_bytes(size) for v in values], pa.binary()))
    return out


#: Bytes of an address, of 4 or 16, that name its bucket.
CELL_BYTES = {4: 1, 16: 2}


def cut_nested(ranges: DataFrame) -> DataFrame:
    """The ranges (BINARY lo and hi, both families) cut into disjoint ones: every address keeps its narrowest range.

    Ranges go to the buckets of their first byte, or two for IPv6, and each bucket is swept by itself. A range listed
    twice counts once. Ranges that overlap without being nested, or repeat with other values, fail the query.
    """
    width = F.when(F.octet_length("lo") == 4, CELL_BYTES[4]).otherwise(CELL_BYTES[16])
    cell = lambda name: F.conv(F.hex(F.substring(F.col(name), F.lit(1), width)), 16, 10).cast("bigint")
    split = ranges.withColumn("_cell", F.explode(F.sequence(cell("lo"), cell("hi"))))
    names = [f.name for f in ranges.schema if f.name not in ("lo", "hi")]
    schema = ", ".join([*[f"`{n}` {ranges.schema[n].dataType.simpleString()}" for n in names], "lo binary, hi binary"])
    grouped = split.select(*names, "lo", "hi", "_cell").groupBy(F.octet_length("lo"), "_cell")
    return grouped.applyInArrow(_innermost, schema).select(ranges.columns)


def spread_ranges(ranges: DataFrame) -> DataFrame:
    """One row, or two, per range: its level and bucket."""
    lo, hi = F.col("lo"), F.col("hi")
    level = F.lit(0)
    for k in sorted(BUCKET_LEVELS):
        near = address_bucket(hi, k) - address_bucket(lo, k) <= 1
        level = F.when(near, k).otherwise(level)
    span = F.lit(None).cast("array<bigint>")
    for k in BUCKET_LEVELS:
        span = F.when(F.col("_level") == k, F.sequence(address_bucket(lo, k), address_bucket(hi, k))).otherwise(span)
    return once(ranges, _level=level).withColumn("_bucket", F.explode(span))


def _lookup(df: DataFrame, ranges: DataFrame, attributes: list[str], on_version: bool) -> DataFrame:
    spread = spread_ranges(ranges).select(
        F.col("_level"), F.col("_bucket").alias("_r_bucket"), F.col("lo").alias("_r_lo"), F.col("hi").alias("_r_hi"),
        *([F.col("version").alias("_r_version")] if on_version else []),
        F.struct(*attributes).alias("_r_found"),
    )
    out = df
    for k in BUCKET_LEVELS:
        side = spread.where(F.col("_level") == k).drop("_level").withColumnRenamed("_r_found", f"_found_{k}")
        match = (
            (address_bucket(F.col("client_bin"), k) == F.col("_r_bucket"))
            & (F.col("client_bin") >= F.col("_r_lo"))
            & (F.col("client_bin") <= F.col("_r_hi"))
        )
        if on_version:
            match = match & (F.col("_version") == F.col("_r_version"))
        out = out.join(side, match, "left").drop("_r_bucket", "_r_lo", "_r_hi", "_r_version")
    found = F.coalesce(*[F.col(f"_found_{k}") for k in BUCKET_LEVELS])
    out = out.withColumn("_found", found).drop(*[f"_found_{k}" for k in BUCKET_LEVELS])
    return out.withColumns({f"_r_{a}": F.col("_found")[a] for a in attributes}).drop("_found")


def _or_unknown(name: str) -> Column:
    return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(UNKNOWN))


def _country_columns(joined: DataFrame) -> DataFrame:
    return (
        joined.withColumn("country", _or_unknown("_r_country"))
        .withColumn("continent", _or_unknown("_r_continent"))
        .drop("_r_country", "_r_continent")
    )


def _asn_columns(joined: DataFrame) -> DataFrame:
    known = F.col("_r_asn") != 0
    return (
        joined.withColumn("asn", F.when(known, F.col("_r_asn")))
        .withColumn("as_org", F.when(known, _or_unknown("_r_as_org")).otherwise(UNKNOWN))
        .drop("_r_asn", "_r_as_org")
    )


def enrich_country(df: DataFrame, ranges: DataFrame) -> DataFrame:
    """Add ``country`` and ``continent``; each falls back to 'unknown' alone."""
    return _country_columns(_lookup(df, ranges, ["country", "continent"], False))


def enrich_asn(df: DataFrame, ranges: DataFrame) -> DataFrame:
    """Add ``asn`` (NULL for none or 0) and ``as_org``."""
    return _asn_columns(_lookup(df, ranges, ["asn", "as_org"], False))


def table_timeline(landings: DataFrame, check_every: int = RELOAD_CHECK_S) -> DataFrame:
    """When each version of a lookup table is in use.

    ``landings(db, seen_at, version, readable, present)`` lists what the reload
    check would find. A version counts from the next check on; a vanished file
    leaves the old version in place; an unreadable one is in use but empty.
    Times are epoch seconds; the last version is open-ended.
    """
    found = landings.where("present").withColumn("valid_from", ceil_to(F.col("seen_at"), check_every))
    latest = found.groupBy("db", "valid_from").agg(
        F.max_by(F.struct("version", "readable"), "seen_at").alias("_v")
    )
    order = W.partitionBy("db").orderBy("valid_from")
    return latest.select(
        "db",
        F.col("_v.version").alias("version"),
        F.col("_v.readable").alias("readable"),
        "valid_from",
        F.lead("valid_from").over(order).alias("valid_to"),
    )


def stamp_version(df: DataFrame, timeline: DataFrame, db: str, until: Column) -> DataFrame:
    """Add the table version in use when each packet was seen (NULL: nothing loaded).

    Validity is spread over days up to ``until`` (epoch seconds, at least the
    newest packet), which makes the as-of lookup an equi-join on the day.
    """
    open_end = F.coalesce(F.col("valid_to"), F.lit(until + 1))
    spans = (
        timeline.where((F.col("db") == db) & (F.col("valid_from") <= until))
        .withColumn("_to", open_end)
        .withColumn(
            "_day",
            F.explode(F.sequence(grid_index(F.col("valid_from"), DAY_S), grid_index(F.col("_to") - 1, DAY_S))),
        )
        .select(
            F.col("_day").alias("_v_day"),
            F.col("valid_from").alias("_v_from"),
            F.col("_to").alias("_v_to"),
            F.when(F.col("readable"), F.col("version")).alias("_version"),
        )
    )
    at = F.col("ts_ns")
    inside = (at >= F.col("_v_from") * SECOND_NS) & (at < F.col("_v_to") * SECOND_NS)
    keyed = df.withColumn("_day", grid_index(at, DAY_S * SECOND_NS))
    return keyed.join(spans, (F.col("_day") == F.col("_v_day")) & inside, "left").drop(
        "_day", "_v_day", "_v_from", "_v_to"
    )


def enrich_country_versioned(
    df: DataFrame, ranges: DataFrame, timeline: DataFrame, until: Column
) -> DataFrame:
    """``enrich_country`` with the table version in use at each packet's time."""
    stamped = stamp_version(df, timeline, "country", until)
    return _country_columns(_lookup(stamped, ranges, ["country", "continent"], True)).drop("_version")


def enrich_asn_versioned(
    df: DataFrame, ranges: DataFrame, timeline: DataFrame, until: Column
) -> DataFrame:
    stamped = stamp_version(df, timeline, "asn", until)
    return _asn_columns(_lookup(stamped, ranges, ["asn", "as_org"], True)).drop("_version")
