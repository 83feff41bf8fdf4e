"""Packet counts per flush window, drops, and the top-network fold.

``flush`` is the start of a window of ``every`` seconds, in epoch seconds.
Counts aggregate partially before the shuffle, so a hot label costs one row per
task. Inputs are packets after ``keep_client_traffic``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalens.functions.slices import running_sum
from stratalens.functions.timegrid import flush_of, grid_index
from stratalens.operators.decode import decode_packets, filter_frames
from stratalens.session import written

FLUSH_S = 15
TOP_N = 25
TOTALS_MAX = 4096
DIRECTIONS = ("request", "response")
FLUSHES_PER_SLICE = 240
COUNTER_SLICE_S = 86_400


def _flushed(packets: DataFrame, every: int) -> DataFrame:
    return packets.withColumn("flush", flush_of(F.col("ts_ns"), every))


def _requests(packets: DataFrame) -> DataFrame:
    return packets.where(F.col("direction") == "request")


def seed(df: DataFrame, keys: list[str], label: str, values: tuple[str, ...], value: str) -> DataFrame:
    """One row per key and listed label, 0 where the input has none.

    With no keys the rows exist even for empty input.
    """
    sums = [
        F.coalesce(F.sum(F.when(F.col(label) == v, F.col(value))), F.lit(0)).alias(f"_s{i}")
        for i, v in enumerate(values)
    ]
    pairs = F.array(
        *[
            F.struct(F.lit(v).alias(label), F.col(f"_s{i}").alias(value))
            for i, v in enumerate(values)
        ]
    )
    return df.groupBy(*keys).agg(*sums).select(*keys, F.inline(pairs))


def packets_by_direction(packets: DataFrame, every: int = FLUSH_S) -> DataFrame:
    counts = _flushed(packets, every).groupBy("flush", "direction").agg(F.count("*").alias("packets"))
    return seed(counts, ["flush"], "direction", DIRECTIONS, "packets")


def requests_by_country(enriched: DataFrame, every: int = FLUSH_S) -> DataFrame:
    return (
        _flushed(_requests(enriched), every)
        .groupBy("flush", "country", "continent")
        .agg(F.count("*").alias("requests"))
    )


def responses_by_country(enriched: DataFrame, every: int = FLUSH_S) -> DataFrame:
    return (
        _flushed(enriched.where(F.col("direction") == "response"), every)
        .groupBy("flush", "country", "continent")
        .agg(F.count("*").alias("responses"))
    )


def drops(enriched: DataFrame, every: int = FLUSH_S) -> DataFrame:
    """Requests without an answer in the same flush, per country; never negative."""
    balance = (
        _flushed(enriched, every)
        .groupBy("flush", "country", "continent")
        .agg(
            F.count_if(F.col("direction") == "request").alias("_req"),
            F.count_if(F.col("direction") == "response").alias("_resp"),
        )
    )
    return balance.where(F.col("_req") > F.col("_resp")).select(
        "flush", "country", "continent", (F.col("_req") - F.col("_resp")).alias("drops")
    )


def requests_by_network(enriched: DataFrame, every: int = FLUSH_S) -> DataFrame:
    """Unfolded counts per (asn, as_org); asn is NULL where unknown."""
    return (
        _flushed(_requests(enriched), every)
        .groupBy("flush", "asn", "as_org")
        .agg(F.count("*").alias("requests"))
    )


def requests_by_version(packets: DataFrame, every: int = FLUSH_S) -> DataFrame:
    return (
        _flushed(_requests(packets), every)
        .groupBy("flush", F.coalesce("version", F.lit("other")).alias("version"))
        .agg(F.count("*").alias("requests"))
    )


def requests_by_family(packets: DataFrame, every: int = FLUSH_S) -> DataFrame:
    return (
        _flushed(_requests(packets), every).groupBy("flush", "family").agg(F.count("*").alias("requests"))
    )


def parse_errors(frames: DataFrame, every: int = FLUSH_S) -> DataFrame:
    """Captured frames that do not decode, per flush that captured any frame."""
    decoded = decode_packets(filter_frames(frames)).select("ts_ns", "parsed")
    return _flushed(decoded, every).groupBy("flush").agg(F.count_if(~F.col("parsed")).alias("errors"))


def to_counter(
    increments: DataFrame, labels: list[str], value: str, out: str = "total",
    slice_s: int = COUNTER_SLICE_S, kind: str = "bigint",
) -> DataFrame:
    """Monotone totals since the first flush, per label set."""
    return running_sum(increments, labels, "flush", [], value, out, slice_s, kind)


def top_asn(totals: DataFrame, n: int = TOP_N) -> DataFrame:
    """The n largest networks; equal totals go by ascending number text."""
    return (
        totals.where(F.col("asn").isNotNull())
        .orderBy(F.col("total").desc(), F.col("asn").cast("string"))
        .limit(n)
    )


def prune_totals(totals: DataFrame, keep: int = TOTALS_MAX) -> DataFrame:
    """Only the largest totals, with the tie order of ``top_asn``."""
    return top_asn(totals, keep)


def _span(value: Column) -> Column:
    """Which of eight spans in its octave a count of 0 or more lies in; greater counts lie in the same span or a later one."""
    octave = F.length(F.bin(value)) - 1
    part = F.call_function("shiftright", value, F.greatest(octave - 3, F.lit(0)))
    return F.when(value < 8, value).otherwise(octave * 8 + part - 8).cast("int")


def _first_above(rows: DataFrame, value: str, bars: DataFrame, out: str) -> DataFrame:
    """rows with the slice of the first bar above their value (NULL: none); bars (slice, bar) never fall from slice to slice.

    Rows and bars of one span of values are scanned together, from the greatest value down. A row whose span has no bar
    above it takes the first bar of a later span, of which there are at most 512.
    """
    names = rows.columns
    kinds = rows.select(*names, F.col(value).alias("_value"), F.lit(0).alias("_kind"), F.lit(None).cast("bigint").alias("_bar_slice"))
    marks = bars.select(
        *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in names],
        F.col("bar").alias("_value"), F.lit(1).alias("_kind"), F.col("slice").alias("_bar_slice"),
    )
    down = W.partitionBy("_span").orderBy(F.col("_value").desc(), "_kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = kinds.unionByName(marks).withColumn("_span", _span(F.col("_value")))
    within = both.withColumn("_here", F.min("_bar_slice").over(down)).where("_kind = 0")
    later = bars.groupBy(_span(F.col("bar")).alias("_above")).agg(F.min("slice").alias("_first"))
    spans = later.agg(F.sort_array(F.collect_list(F.struct("_above", "_first"))).alias("_later"))
    beyond = F.array_min(F.transform(F.filter("_later", lambda x: x["_above"] > F.col("_span")), lambda x: x["_first"]))
    found = within.select("_span").distinct().join(F.broadcast(spans)).select(F.col("_span").alias("_of"), beyond.alias("_beyond"))
    joined = within.join(found, F.col("_span") == F.col("_of"), "left")
    return joined.select(*names, F.coalesce("_here", "_beyond").alias(out))


def carried_totals(per_slice: DataFrame, n: int) -> DataFrame:
    """(slice, asn, start, gain): every network in the slices of its gains, and in the silent ones where it may rank.

    A network that is silent in a slice ranks only if it is among the top n at its start. Totals never fall, so once n
    networks have ended some slice above its total it is out until it gains again: it is carried up to that slice, which
    leaves about n silent networks per slice however many there are.
    """
    order = W.partitionBy("asn").orderBy("slice")
    summed = per_slice.withColumn("_end", F.sum("gain").over(order)).withColumn("_next", F.lead("slice").over(order))
    by_end = W.partitionBy("slice").orderBy(F.col("_end").desc())
    nth = summed.withColumn("_rn", F.row_number().over(by_end)).where(F.col("_rn") <= n).where(F.col("_rn") == n)
    rising = W.orderBy("slice").rowsBetween(W.unboundedPreceding, W.currentRow)  # one row per slice
    bars = nth.select((F.col("slice") + 1).alias("slice"), F.max("_end").over(rising).alias("bar"))
    last_slice = per_slice.agg(F.max("slice")).scalar()
    bounded = _first_above(summed, "_end", bars, "_out")
    until = F.least(F.coalesce(F.col("_next") - 1, last_slice), F.coalesce(F.col("_out") - 1, last_slice))
    silent = (
        bounded.withColumn("_until", until)
        .where(F.col("_until") > F.col("slice"))
        .select(F.explode(F.sequence(F.col("slice") + 1, F.col("_until"))).alias("slice"), "asn", F.col("_end").alias("start"))
    )
    gaining = summed.select("slice", "asn", (F.col("_end") - F.col("gain")).alias("start"), "gain")
    return gaining.unionByName(silent.withColumn("gain", F.lit(0).cast("bigint")))


def top_asn_by_flush(
    counts: DataFrame, n: int = TOP_N, every: int = FLUSH_S, flushes_per_slice: int = FLUSHES_PER_SLICE
) -> DataFrame:
    """Top-n networks by lifetime total at every flush that has a count.

    A network that is silent in a flush still ranks, but pairing all networks
    with all flushes would grow with their product. Totals never fall, so inside
    a slice of flushes only networks whose total at the slice's end reaches the
    n-th largest total at its start can rank; only those candidates are laid out
    over the flushes, which is about the size of the result itself. The counts
    are used several times and therefore written to the shared folder first.
    """
    width = every * flushes_per_slice
    base = written(
        counts.where(F.col("asn").isNotNull())
        .groupBy("flush", "asn")
        .agg(F.sum("requests").alias("requests"))
        .withColumn("slice", grid_index(F.col("flush"), width)),
        "network-counts",
    )
    state = carried_totals(base.groupBy("asn", "slice").agg(F.sum("requests").alias("gain")), n)
    by_start = W.partitionBy("slice").orderBy(F.col("start").desc(), F.col("asn").cast("string"))
    bar = (
        state.where(F.col("start") > 0)
        .withColumn("_rn", F.row_number().over(by_start))
        .where(F.col("_rn") <= n)
        .where(F.col("_rn") == n)
        .select("slice", F.col("start").alias("bar"))
    )
    candidates = (
        state.join(bar, "slice", "left")
        .where(F.col("start") + F.col("gain") >= F.coalesce(F.col("bar"), F.lit(0)))
        .select("slice", "asn", "start")
    )
    flushes = base.select("slice", "flush").distinct()
    in_slice = W.partitionBy("slice", "asn").orderBy("flush").rowsBetween(W.unboundedPreceding, 0)
    totals = (
        candidates.join(flushes, "slice")
        .join(base.drop("slice"), ["flush", "asn"], "left")
        .withColumn("total", F.col("start") + F.coalesce(F.sum("requests").over(in_slice), F.lit(0)))
        .where(F.col("total") > 0)
    )
    ranking = W.partitionBy("flush").orderBy(F.col("total").desc(), F.col("asn").cast("string"))
    return (
        totals.select("flush", "asn", "total")
        .withColumn("rank", F.row_number().over(ranking))
        .where(F.col("rank") <= n)
    )


def fold_asn(counts: DataFrame, top: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Replace asn and as_org by labels: kept, other/other or unknown/unknown."""
    on = on or ["asn"]
    member = top.select(*on).distinct().withColumn("_top", F.lit(True))
    joined = counts.join(member, on, "left")
    missing, kept = F.col("asn").isNull(), F.col("_top").isNotNull()
    label = F.when(missing, "unknown").when(kept, F.col("asn").cast("string")).otherwise("other")
    org = F.when(missing, "unknown").when(kept, F.col("as_org")).otherwise("other")
    return joined.withColumn("_label", label).withColumn("_org", org).select(
        *[c for c in counts.columns if c not in ("asn", "as_org")],
        F.col("_label").alias("asn"),
        F.col("_org").alias("as_org"),
    )


def requests_by_asn(enriched: DataFrame, top_n: int = TOP_N, every: int = FLUSH_S,
                    flushes_per_slice: int = FLUSHES_PER_SLICE) -> DataFrame:
    """Requests per network label; past flushes keep the label they had then."""
    counts = requests_by_network(enriched, every)
    top = top_asn_by_flush(counts, top_n, every, flushes_per_slice)
    folded = fold_asn(counts, top, ["flush", "asn"])
    return folded.groupBy("flush", "asn", "as_org").agg(F.sum("requests").alias("requests"))
