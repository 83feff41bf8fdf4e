"""Continuous forms of the batch operators, as work for event-time steps, and windows and joins of streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalens.functions.sketch import DEFAULT_P
from stratalens.functions.timegrid import SECOND_NS, flush_of
from stratalens.operators import clients, latency, pool, traffic
from stratalens.operators.steps import AT, LATE, Step

TOTALS = "family STRING, l1 STRING, l2 STRING, total LONG"
NETWORKS = "asn LONG, as_org STRING, requests LONG"


def windowed_counts(stream: DataFrame, keys: list[str], every: int, late: str, out: str) -> DataFrame:
    """Rows per key and flush window of `every` seconds; rows later than `late` behind the newest drop out."""
    windows = stream.withWatermark("ts", late).groupBy(F.window("ts", f"{every} seconds").alias("w"), *keys)
    return windows.agg(F.count("*").alias(out)).select(F.unix_seconds("w.start").alias("flush"), *keys, out)


def label_counts(packets: DataFrame, every: int) -> DataFrame:
    """(flush, family, l1, l2, n): packets of every label set of every family, in one pass and one shuffle.

    Needs country, continent, asn and as_org. Partial counts go first, so a hot label costs one row per task.
    """
    request = F.col("direction") == "request"

    def labels(family: str, first, second=None):
        second = F.lit("") if second is None else second
        return F.struct(F.lit(family).alias("family"), first.cast("string").alias("l1"), second.alias("l2"))

    sets = F.array_compact(F.array(
        labels("packets", F.col("direction")),
        F.when(request, labels("requests", F.col("country"), F.col("continent"))),
        F.when(~request, labels("responses", F.col("country"), F.col("continent"))),
        F.when(request, labels("networks", F.col("asn"), F.col("as_org"))),
        F.when(request, labels("versions", F.coalesce("version", F.lit("other")))),
        F.when(request, labels("families", F.col("family"))),
    ))
    stacked = packets.select(flush_of(F.col("ts_ns"), every).alias("flush"), F.inline(sets))
    return stacked.groupBy("flush", "family", "l1", "l2").agg(F.count("*").alias("n"))


def _family(counts: DataFrame, family: str) -> DataFrame:
    return counts.where(F.col("family") == family)


def _ranked(before: DataFrame, own: DataFrame, top: int) -> DataFrame:
    """(flush, asn): the largest networks by total at each flush of `own`, as in ``traffic.top_asn_by_flush``.

    Totals never fall, so a network ranks in the step only if its total at the end reaches the top-th total at the
    start; those few are laid out over the step's flushes.
    """
    start = before.where("asn IS NOT NULL").groupBy("asn").agg(F.sum("requests").alias("start"))
    least = start.orderBy(F.col("start").desc()).limit(top).agg(F.when(F.count("*") == top, F.min("start"))).scalar()
    gains = own.where("asn IS NOT NULL").groupBy("flush", "asn").agg(F.sum("requests").alias("gain"))
    flushes = gains.agg(F.collect_set("flush")).scalar()
    end = start.unionByName(gains.select("asn", F.col("gain").alias("start"))).groupBy("asn").agg(F.sum("start").alias("end"))
    able = end.where(F.col("end") >= F.coalesce(least, F.lit(0))).join(start, "asn", "left")
    laid = able.select("asn", F.coalesce("start", F.lit(0)).alias("start"), F.explode(flushes).alias("flush"))
    so_far = W.partitionBy("asn").orderBy("flush").rowsBetween(W.unboundedPreceding, W.currentRow)
    totals = laid.join(gains, ["flush", "asn"], "left").withColumn("total", F.col("start") + F.coalesce(F.sum("gain").over(so_far), F.lit(0)))
    order = W.partitionBy("flush").orderBy(F.col("total").desc(), F.col("asn").cast("string"))
    return totals.where("total > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("flush", "asn")


def _networks(step: Step, counts: DataFrame, top: int) -> DataFrame:
    """Counts by network, folded by the totals of all time up to each flush."""
    own = _family(counts, "networks").select("flush", F.col("l1").cast("long").alias("asn"), F.col("l2").alias("as_org"), F.col("n").alias("requests"))
    before = step.state("networks", NETWORKS)
    step.keep("networks", before.unionByName(own.drop("flush")).groupBy("asn", "as_org").agg(F.sum("requests").alias("requests")))
    folded = traffic.fold_asn(own, _ranked(before, own, top), ["flush", "asn"])
    folded = folded.groupBy("flush", "asn", "as_org").agg(F.sum("requests").alias("n"))
    return folded.select("flush", F.lit("networks").alias("family"), F.col("asn").alias("l1"), F.col("as_org").alias("l2"), "n")


def flush_families(
    step: Step, packets: DataFrame, frames: DataFrame, every: int, top: int = traffic.TOP_N,
) -> DataFrame:
    """(family, flush, l1, l2, n, total): all counters of every flush that the step closes, and their totals since the start.

    packets: the step's packets with country and network; frames: its frames. Families: packets by direction (both, 0 where there are none), requests
    by country, drops, requests by network (top ones by name), by version and by family of address, and parse errors. The
    state is a total for each label set and each network.
    """
    counts = label_counts(packets, every).persist()  # every family and both states are made of it
    directions = traffic.seed(
        _family(counts, "packets").select("flush", F.col("l1").alias("direction"), F.col("n").alias("packets")),
        ["flush"], "direction", traffic.DIRECTIONS, "packets",
    )
    balance = counts.where(F.col("family").isin("requests", "responses")).groupBy("flush", "l1", "l2").agg(
        F.sum(F.when(F.col("family") == "requests", F.col("n")).otherwise(-F.col("n"))).alias("n")
    )
    columns = ["family", "flush", "l1", "l2", "n"]
    parts = [
        directions.select(F.lit("packets").alias("family"), "flush", F.col("direction").alias("l1"), F.lit("").alias("l2"), F.col("packets").alias("n")),
        counts.where(F.col("family").isin("requests", "versions", "families")),
        balance.where("n > 0").withColumn("family", F.lit("drops")),
        _networks(step, counts, top),
        traffic.parse_errors(frames, every).select(F.lit("errors").alias("family"), "flush", F.lit("").alias("l1"), F.lit("").alias("l2"), F.col("errors").alias("n")),
    ]
    rows = parts[0].select(columns)
    for part in parts[1:]:
        rows = rows.unionByName(part.select(columns))
    rows = rows.persist()
    keys = ["family", "l1", "l2"]
    before = step.state("totals", TOTALS)
    step.keep("totals", before.unionByName(rows.groupBy(*keys).agg(F.sum("n").alias("total"))).groupBy(*keys).agg(F.sum("total").alias("total")))
    step.release(counts)
    step.release(rows)
    running = rows.withColumn("_inside", F.sum("n").over(W.partitionBy(*keys).orderBy("flush")))  # a row per flush of the step
    return running.join(before, keys, "left").select(*columns, (F.col("_inside") + F.coalesce("total", F.lit(0))).alias("total"))


def late_counts(step: Step, keys: list[str], every: int) -> DataFrame:
    """(flush, keys, packets, late): rows by the flush in which they count, and how many of them came late."""
    rows = step.rows.withColumn("flush", flush_of(F.col(AT), every))
    return rows.groupBy("flush", *keys).agg(F.count("*").alias("packets"), F.count_if(LATE).alias("late"))


def active_step(step: Step, packets: DataFrame, window: int, every: int) -> DataFrame:
    """(tick, active): clients seen in [tick - window, tick] at each tick of the step; the state is one row per client, its last request."""
    schema = "client_ip STRING, ts_ns LONG"
    own = packets.where("direction = 'request'").select("client_ip", "ts_ns")
    rows = step.state("clients", schema).unionByName(own).withColumn("direction", F.lit("request"))
    last = rows.groupBy("client_ip").agg(F.max("ts_ns").alias("ts_ns"))
    step.keep("clients", last.where(F.col("ts_ns") >= (step.until - window - every) * SECOND_NS))
    found = clients.active_clients(rows, window, every).where(step.inside(F.col("tick")))
    if step.since is None:
        return found
    ticks = step.spark.range(step.since, step.until, every).toDF("tick")
    return ticks.join(found, "tick", "outer" if step.last else "left").select("tick", F.coalesce("active", F.lit(0)).cast("long").alias("active"))


def hourly_step(step: Step, packets: DataFrame, hours: int = clients.SKETCH_HOURS, p: int = DEFAULT_P) -> DataFrame:
    """(hour, unique_clients) of each hour that the step closes; the state is the registers of the last `hours` hours."""
    schema = "hour LONG, idx INT, rho INT, p INT"
    own = clients.hourly_registers(packets, p).select("hour", F.col("idx").cast("int"), F.col("rho").cast("int"), "p")
    kept = step.hold(step.state("registers", schema).unionByName(own))  # the sums over hours and the state read it many times
    step.keep("registers", kept.where(F.col("hour") > step.until - (hours + 1) * clients.HOUR_S))
    return clients.daily_from_registers(kept, hours, step.hold).where(step.inside(F.col("hour")))


def pair_step(step: Step, packets: DataFrame, ttl: float) -> DataFrame:
    """Responses with the live request they use up; the state is the last packet of each (client, id), for `ttl` seconds.

    Late packets take no part: a pair needs both times.
    """
    schema = "seq LONG, ts_ns LONG, direction STRING, client_ip STRING, xid BINARY"
    names = ["seq", "ts_ns", "direction", "client_ip", "xid"]
    rows = step.state("open", schema).unionByName(packets.where("xid IS NOT NULL").select(*names))
    last = rows.groupBy("client_ip", "xid").agg(F.max(F.struct("ts_ns", "seq", "direction")).alias("m"))
    last = last.select("m.seq", "m.ts_ns", "m.direction", "client_ip", "xid")
    step.keep("open", last.where(F.col("ts_ns") >= step.until * SECOND_NS - int(ttl * SECOND_NS)))
    return latency.pair_latency(rows, ttl).where(step.inside(F.col("ts_ns"), SECOND_NS))


def interval_step(step: Step, packets: DataFrame, window: int, every: int) -> DataFrame:
    """Seconds since the client's previous request; the state is one row per client, for window + every seconds."""
    schema = "seq LONG, ts_ns LONG, client_ip STRING"
    own = packets.where("direction = 'request'").select("seq", "ts_ns", "client_ip")
    rows = step.state("last", schema).unionByName(own)
    last = rows.groupBy("client_ip").agg(F.max(F.struct("ts_ns", "seq")).alias("m")).select("m.seq", "m.ts_ns", "client_ip")
    step.keep("last", last.where(F.col("ts_ns") >= (step.until - window - every) * SECOND_NS))
    found = clients.request_intervals(rows.withColumn("direction", F.lit("request")), window, every)
    return found.where(step.inside(F.col("ts_ns"), SECOND_NS))


def in_time(step: Step) -> DataFrame:
    """The step's rows but for late ones."""
    return step.rows.where(~F.col(LATE))


def poll_stream(docs: DataFrame, limit: str) -> DataFrame:
    """Poll outcomes: the two kinds of documents of one (ip, poll_ts) joined, however far apart they come.

    Both there: the outcome comes out at once. One alone waits in state until the newest poll of both kinds is `limit` ahead,
    then the poll has failed. A document that comes twice within the limit counts once.
    """
    sides = []
    for kind in pool.KINDS:
        own = docs.where(F.col("kind") == kind).withWatermark("poll_ts", limit).dropDuplicatesWithinWatermark(["ip", "poll_ts"])
        sides.append(own.select(F.col("ip").alias(f"ip_{kind}"), F.col("poll_ts").alias(f"ts_{kind}"), F.col("body").alias(f"body_{kind}")))
    a, b = pool.KINDS
    same = (F.col(f"ip_{a}") == F.col(f"ip_{b}")) & (F.col(f"ts_{a}") == F.col(f"ts_{b}"))
    joined = sides[0].join(sides[1], same, "full_outer")
    return joined.select(
        F.coalesce(f"ip_{a}", f"ip_{b}").alias("ip"), F.coalesce(f"ts_{a}", f"ts_{b}").alias("poll_ts"),
        *[F.col(f"body_{kind}") for kind in pool.KINDS],
    )


def poll_outcomes(joined: DataFrame) -> DataFrame:
    """``pool.poll_results`` of rows with a body for each kind, null where it did not come."""
    docs = [F.struct(F.lit(kind).alias("kind"), F.col(f"body_{kind}").alias("body")) for kind in pool.KINDS]
    came = [F.when(F.col(f"body_{kind}").isNotNull(), doc) for kind, doc in zip(pool.KINDS, docs, strict=True)]
    return pool.poll_results(joined.select("ip", "poll_ts", F.inline(F.array_compact(F.array(*came)))))


def drain(stream: DataFrame, path: str, mode: str = "append", each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a stream to the present end of its source and read what it wrote below `path`.

    Each micro-batch goes to a folder of its own, written anew if the batch is redone; ``batch`` is its number. In update mode
    later batches hold the newer value of a key.
    """

    def put(batch: DataFrame, number: int) -> None:
        (each(batch) if each else batch).write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint")
    query = writer.foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(f"{path}/out")


def latest(written: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The newest value of each key of an update-mode stream."""
    return written.groupBy(*keys).agg(F.max_by(value, "batch").alias(value))
